"""Tables that a stream maintains batch by batch in a shared folder."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.times import event_date
from ..session import hadoop_path

#: Versions between two micro-batches, for what is written while no batch runs.
BETWEEN = 1_000_000
#: Folders that the rows of a keyed table are dealt over by a hash, unless its first writer says
#: otherwise. A large table wants one for every few hundred megabytes.
BUCKETS = 32
#: Rows of a batch that are looked at before it is asked as a whole which buckets it falls in.
LOOKED_AT = 1000
#: Commits that are listed; what is older is known to be committed.
KEPT_COMMITS = 100


def _names(spark: SparkSession, path: str) -> list[str]:
    files, place = hadoop_path(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(place)] if files.exists(place) else []


def _is_complete(spark: SparkSession, path: str) -> bool:
    files, place = hadoop_path(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def _size(spark: SparkSession, path: str) -> int:
    files, place = hadoop_path(spark, path)
    return files.getContentSummary(place).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    files, place = hadoop_path(spark, path)
    files.delete(place, True)


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, place = hadoop_path(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place at once; false if there is one already."""
    files, place = hadoop_path(spark, path)
    files.mkdirs(place.getParent())
    part = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{place.getName()}-{spark._jvm.java.util.UUID.randomUUID()}")
    stream = files.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        # fails when the name is taken, unlike a plain rename on some file systems
        hadoop.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration()).rename(part, place, none)
        return True
    except Exception:
        if not files.exists(place):
            raise
        files.delete(part, False)
        return False


class Commits:
    """Which versions several tables show, so that they show one together.

    A version is committed after all tables have written it, by a file named for the
    version that its writer started from. Only one version can follow another: of two
    writers that started from the same one, the second is refused and starts again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _parents(self) -> list[int]:
        return sorted(int(n.removeprefix("after=")) for n in _names(self.spark, self.path) if n.startswith("after="))

    def head(self) -> int:
        """The newest committed version; -1 before the first."""
        parents = self._parents()
        return int(_read_text(self.spark, f"{self.path}/after={parents[-1]}")) if parents else -1

    def holds(self) -> tuple[int, set[int]]:
        """(oldest listed version, listed versions): committed are the listed ones and what was left before the oldest."""
        parents = self._parents()
        return (parents[0], {*parents, self.head()}) if parents else (-1, set())

    def has(self, version: int) -> bool:
        oldest, listed = self.holds()
        return version in listed or 0 <= version < oldest

    def commit(self, parent: int, version: int) -> bool:
        """Show ``version``, written on top of ``parent``; false if another writer was first."""
        if not _write_text(self.spark, f"{self.path}/after={parent}", str(version)):
            return False
        for old in self._parents()[:-KEPT_COMMITS]:
            _delete(self.spark, f"{self.path}/after={old}")
        return True


class _Stored:
    """A folder of numbered versions, and what its readers have to know."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema
        self._facts: dict = {}

    def facts(self) -> dict:
        """What is written down beside the versions."""
        if not self._facts:
            self._facts = json.loads(_read_text(self.spark, f"{self.path}/_table") or "{}")
        return self._facts

    def note(self, **facts) -> dict:
        """Write down what every later reader needs; the first writer's word holds."""
        known = self.facts()
        if not known:
            _write_text(self.spark, f"{self.path}/_table", json.dumps(facts))
            known = self.facts()
        return known

    def _commits(self) -> Commits | None:
        place = self.facts().get("commits")
        return Commits(self.spark, place) if place else None

    def _shown(self, versions: list[int]) -> set[int]:
        """Those of the given versions that readers may see."""
        commits = self._commits()
        if commits is None:
            return set(versions)
        oldest, listed = commits.holds()
        return {v for v in versions if v in listed or v < oldest}


@dataclass(frozen=True)
class _Run:
    """A folder that holds the changes of the versions from ``low`` to ``high``; all that came before as well, if ``low`` is 0."""

    high: int
    low: int
    name: str


class VersionedTable(_Stored):
    """A table of which every micro-batch makes a new version.

    Batch n reads the newest version before its own number and writes that number,
    so a repeated batch starts from the same state and replaces its own output.
    What a reader sees comes from storage alone, also after a restart. What no repeat
    can need any more is deleted.

    ``write`` stores a version in full. A table with keys (see ``keyed``) can instead be
    changed: ``change`` stores the changed rows alone, dealt over ``buckets`` folders by a
    hash of the leading keys, and readers take the newest row of a key. Runs of changes are merged
    when they are no smaller than the one before, so that there are few of them and a row is
    rewritten a logarithmic number of times.
    """

    def keyed(self, keys: list[str], by: list[str] | None = None, buckets: int = BUCKETS, commits: Commits | None = None) -> VersionedTable:
        """This table with keys; ``by``: the columns whose hash deals the rows. What is stored already keeps its own."""
        self.note(keys=keys, by=by or keys, buckets=buckets, commits=commits.path if commits else None)
        return self

    def _runs(self, below: int | None = None) -> list[_Run]:
        """The runs that make up the newest version below a number, newest first."""
        found = []
        for name in _names(self.spark, self.path):
            if m := re.fullmatch(r"v=(\d+)(?:-(\d+))?", name):
                found.append(_Run(int(m[1]), int(m[2] or 0), name))
        shown = self._shown([r.high for r in found])
        usable = [r for r in found if r.high in shown and (below is None or r.high < below) and _is_complete(self.spark, f"{self.path}/{r.name}")]
        made: list[_Run] = []
        for run in sorted(usable, key=lambda r: (-r.high, r.low)):
            if not made or run.high < made[-1].low:
                made.append(run)
        return made

    def newest(self, below: int | None = None) -> int | None:
        """Number of the newest complete version, of those below a number."""
        runs = self._runs(below)
        return runs[0].high if runs else None

    def at(self, version: int | None, only: DataFrame | None = None) -> DataFrame:
        """A version; ``only``: rows with the columns that deal them out, whose buckets are read."""
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self._runs(version + 1), only).select(*self.schema.names)

    def before(self, batch: int, only: DataFrame | None = None) -> DataFrame:
        return self.at(self.newest(batch * BETWEEN), only)

    def latest(self, only: DataFrame | None = None) -> DataFrame:
        return self.at(self.newest(), only)

    def _bucket(self) -> Column:
        facts = self.facts()
        return F.pmod(F.xxhash64(*facts["by"]), F.lit(facts["buckets"])).cast("int")

    def _merged(self, runs: list[_Run], only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key, with ``_gone`` if rows can have gone."""
        full = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("_bucket", T.IntegerType())])
        keys = self.facts().get("keys")
        if not keys:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{runs[0].name}")
        parts = [self.spark.read.schema(full).parquet(f"{self.path}/{r.name}") for r in runs]
        if only is not None:
            buckets = only.select(self._bucket().alias("b"))
            some = {r[0] for r in buckets.limit(LOOKED_AT).collect()}
            if len(some) < self.facts()["buckets"]:  # else the first rows fall in all buckets already, and the rest is not made for this
                some = {r[0] for r in buckets.distinct().collect()}
            parts = [p.filter(F.col("_bucket").isin(*some)) for p in parts]
        if len(parts) == 1:
            return parts[0].filter(~F.coalesce("_gone", F.lit(False)))
        rows = None
        for i, part in enumerate(parts):
            aged = part.withColumn("_age", F.lit(i))
            rows = aged if rows is None else rows.unionByName(aged)
        rest = [c for c in (*self.schema.names, "_gone") if c not in keys]
        # each column for itself: a hash aggregate holds numbers and flags, for a struct all rows would be sorted
        newest = rows.groupBy(*keys, "_bucket").agg(*[F.min_by(c, "_age").alias(c) for c in rest]).select(*keys, *rest, "_bucket")
        return newest if runs[-1].low else newest.filter(~F.coalesce("_gone", F.lit(False)))

    def write(self, batch: int, df: DataFrame) -> None:
        self.write_version(batch * BETWEEN, df)

    def write_version(self, version: int, df: DataFrame) -> None:
        """Store a version in full."""
        self._forget(version)
        rows = df.select(*self.schema.names)
        if self.facts().get("keys"):
            self._write_run(f"v={version}", rows.withColumn("_gone", F.lit(False)))
        else:
            rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        self._clean(version)

    def change(self, batch: int, changed: DataFrame) -> None:
        self.change_version(batch * BETWEEN, changed)

    def change_version(self, version: int, changed: DataFrame) -> None:
        """Store the rows that are new or changed, one for each key; ``_gone`` marks those that go."""
        gone = F.coalesce(F.col("_gone"), F.lit(False)) if "_gone" in changed.columns else F.lit(False)
        self._forget(version)
        runs = self._runs(version if self._commits() else version - version % BETWEEN)
        name = f"v={version}-{version}" if runs else f"v={version}"
        self._write_run(name, changed.select(*self.schema.names, gone.alias("_gone")))
        merged, size = [_Run(version, version if runs else 0, name)], _size(self.spark, f"{self.path}/{name}")
        for run in runs:
            own = _size(self.spark, f"{self.path}/{run.name}")
            if own > size:
                break
            merged.append(run)
            size += own
        if len(merged) > 1:
            rows = self._merged(merged)
            self._write_run(f"v={version}-{merged[-1].low}" if merged[-1].low else f"v={version}", rows)
        self._clean(version)

    def _write_run(self, name: str, rows: DataFrame) -> None:
        dealt = rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket")
        dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{name}")

    def _forget(self, version: int) -> None:
        """Delete what an earlier attempt at a version has left."""
        for name in _names(self.spark, self.path):
            if re.fullmatch(rf"v={version}(-\d+)?", name):
                _delete(self.spark, f"{self.path}/{name}")

    def _clean(self, version: int) -> None:
        """Delete what neither this version nor a repeat of its batch reads."""
        before = self._runs(version if self._commits() else version - version % BETWEEN)
        needed = {r.name for r in before}
        for name in _names(self.spark, self.path):
            m = re.fullmatch(r"v=(\d+)(?:-\d+)?", name)
            if before and m and name not in needed and int(m[1]) < before[0].high:
                _delete(self.spark, f"{self.path}/{name}")


class BatchLog(_Stored):
    """An append-only table with one folder per micro-batch, so a repeat replaces itself.

    ``dated`` tables are also split by the UTC day of created_at, for pruning.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, dated: bool = False):
        super().__init__(spark, path, schema)
        self.dated = dated

    def write(self, batch: int, df: DataFrame) -> None:
        self.write_version(batch * BETWEEN, df)

    def write_version(self, version: int, df: DataFrame) -> None:
        rows = df.select(*self.schema.names)
        if not self.dated:
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={version}")
            return
        days = rows.withColumn("event_date", event_date(F.col("created_at")))
        days.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").parquet(f"{self.path}/batch={version}")

    def at(self, batch: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch * BETWEEN}")

    def _named(self) -> list[int]:
        return [int(n.removeprefix("batch=")) for n in _names(self.spark, self.path) if n.startswith("batch=")]

    def drop_hidden(self, below: int) -> None:
        """Delete versions below a number that were written but never committed."""
        named = [v for v in self._named() if v < below]
        for v in set(named) - self._shown(named):
            _delete(self.spark, f"{self.path}/batch={v}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of earlier batches only."""
        extra = [T.StructField("batch", T.LongType())]
        if self.dated:
            extra.append(T.StructField("event_date", T.DateType()))
        full = T.StructType([*self.schema.fields, *extra])
        named = self._named()
        if not any(_is_complete(self.spark, f"{self.path}/batch={v}") for v in named):  # nothing written yet
            return self.spark.createDataFrame([], full).drop("batch")
        rows = self.spark.read.schema(full).parquet(self.path)
        if hidden := set(named) - self._shown(named):
            rows = rows.filter(~rows["batch"].isin(*hidden))
        if before is not None:
            rows = rows.filter(rows["batch"] < before * BETWEEN)
        return rows.drop("batch")
