"""Reading log files as numbered lines.

A log is read as splittable text, so one huge file spreads over many tasks. The
line number is rebuilt from the split a line came from and its place within it:
splits are counted, the counts add up along each file, and the sum is joined
back. No task sees a whole file. The table of splits is small; while it is, it goes
to all tasks and no text moves.

Which files have to be read is decided from the list of files, which holds no content.
On a local file system that list is made, and small files are read, by tasks without Spark's
file index: it keeps every file on the driver and opens each at a cost of milliseconds.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import hadoop_path, staged

#: Splits up to which their table is broadcast (about a hundred bytes each).
BROADCAST_SPLITS = 100_000
#: Bytes up to which ``read_files`` has a task read a local file whole; larger ones are split by Spark's reader.
WHOLE_FILE = 4 << 20
#: Bytes of text that a task hands over at once.
TEXT_BATCH = 8 << 20
#: Bytes of files, and number of files, for each task that reads whole files.
TASK_BYTES, TASK_FILES = 64 << 20, 10_000

_FILES = "file_path string, file_name string, file_size bigint, file_modified_ns bigint"
_GLOB = re.compile(r"[{}\[\]*?\\]")
# Fixed patterns: what java.net.URI quotes in a path, and names that Hadoop's text input decompresses.
_QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*:@&=+$,;/\x80-\U0010ffff]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd|passthrough)$"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Lists many paths in a few tasks for each core; Spark's own default is a task a path, up to 10,000."""
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def _local(spark: SparkSession, paths: list[str]) -> list[str] | None:
    """The paths on a local file system, if all of them are there as they stand."""
    out = []
    for path in paths:
        files, place = hadoop_path(spark, path)
        own = files.makeQualified(place).toUri().getPath()
        if files.getUri().getScheme() != "file" or _GLOB.search(path) or not os.path.exists(own):
            return None
        out.append(own)
    return out


def _listed(spark: SparkSession, roots: list[str], glob: str | None) -> DataFrame:
    """``list_files`` of local folders: the first levels are opened here, what lies below them by tasks."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    quoted = _QUOTED

    def hidden(name: str) -> bool:
        """Names that Spark leaves out of every listing."""
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    opened, below = [], [r for r in roots if os.path.isdir(r)]
    # one level after another, until there are folders enough for all tasks
    while below and len(below) < tasks:
        opened, level, below = opened + below, below, []
        for folder in level:
            with os.scandir(folder) as found:
                below += [e.path for e in found if not hidden(e.name) and e.is_dir()]
    places = [*((r, False) for r in roots if not os.path.isdir(r)), *((f, False) for f in opened), *((f, True) for f in below)]
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern(), re.DOTALL) if glob else None

    def files_of(place: str, deep: bool) -> Iterator[tuple[str, os.stat_result]]:
        if not os.path.isdir(place):
            yield place, os.stat(place)
            return
        todo = [place]
        while todo:
            with os.scandir(todo.pop()) as found:
                for e in found:
                    if hidden(e.name):
                        continue
                    try:
                        if e.is_dir():
                            todo += [e.path] if deep else []
                        elif wanted is None or wanted.fullmatch(e.name):
                            yield e.path, e.stat()
                    except FileNotFoundError:  # gone since, or a link to nothing
                        continue

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, stat in files_of(place, deep):
                    if stat.st_size:  # Spark lists no empty file either
                        url = quoted.sub(lambda m: quote(m[0]), path)
                        out.append((f"file:{url}", url.rsplit("/", 1)[1], stat.st_size, stat.st_mtime_ns // 1_000_000 * 1_000_000))
                    if len(out) == 10_000:
                        yield batch_of(out)
                        out = []
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        names, kinds = ("file_path", "file_name", "file_size", "file_modified_ns"), (pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*out) if out else ((),) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    table = pa.table({"place": pa.array([p for p, _ in places], pa.string()), "deep": pa.array([d for _, d in places], pa.bool_())})
    return spark.createDataFrame(table).repartition(tasks).mapInArrow(rows, _FILES)


def list_files(spark: SparkSession, paths: str | list[str], *, glob: str | None = None) -> DataFrame:
    """(file_path, file_name, file_size, file_modified_ns) of the files below the paths, as they are now; no content is read."""
    if (roots := _local(spark, [paths] if isinstance(paths, str) else paths)) is not None:
        files = _listed(spark, roots, glob)
        return staged(files if len(roots) == 1 else files.dropDuplicates(["file_path"]), "files")  # roots may overlap
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with _listing(spark):
        files = reader.load(paths)
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.unix_micros("_metadata.file_modification_time") * 1000).alias("file_modified_ns"),
    )


def read_lines(spark: SparkSession, paths: str | list[str], *, glob: str | None = None, line_sep: str | None = None) -> DataFrame:
    """(file_path, file_name, file_size, file_modified_ns, line_no from 1, value).

    A list of paths is a list of logs, mostly small ones whose opening is what costs: each is opened once and
    its text staged, for counting and for whatever reads the lines. A path is opened by every reader instead.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with _listing(spark):
        text = reader.text(paths)
    raw = text.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        (F.unix_micros("_metadata.file_modification_time") * 1000).alias("file_modified_ns"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    if not isinstance(paths, str):
        raw = staged(raw, "raw-lines")
    splits = raw.groupBy("file_path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "splits")
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return raw.join(offsets, ["file_path", "_split"]).select(
        "file_path",
        "file_name",
        "file_size",
        "file_modified_ns",
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"),
        "value",
    )


def _whole_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``read_lines`` of small local files: a task opens many of them, and numbers their lines as it reads."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("file_size"), F.lit(0))).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)
    most = TEXT_BATCH

    def lines_of(data: bytes) -> list[bytes]:
        """As Hadoop's text input has them: ended by LF, CR or both, without a byte order mark."""
        data = data.removeprefix(b"\xef\xbb\xbf")
        lines = re.split(b"\r\n|\n|\r", data) if b"\r" in data else data.split(b"\n")
        return lines if lines[-1] else lines[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lines, held = [], [], 0

        def batch_of() -> pa.RecordBatch:
            counts = [n for *_, n in own]
            path, name, size, time = (pa.array(c, k) for c, k in zip(list(zip(*own))[:4] or [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64())))
            at = pa.array(np.repeat(np.arange(len(own)), counts))
            numbers = np.concatenate([np.arange(1, n + 1) for n in counts] or [np.arange(0)])
            columns = {"file_path": path.take(at), "file_name": name.take(at), "file_size": size.take(at), "file_modified_ns": time.take(at)}
            return pa.RecordBatch.from_pydict({**columns, "line_no": pa.array(numbers, pa.int64()), "text": pa.array(lines, pa.binary())})

        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(unquote(urlsplit(path).path), "rb") as file:
                    stat = os.fstat(file.fileno())
                    data = file.read()
                found = lines_of(data)
                own.append((path, name, stat.st_size, stat.st_mtime_ns // 1_000_000 * 1_000_000, len(found)))
                lines += found
                held += len(data) + 200 * len(found)
                if held > most:
                    yield batch_of()
                    own, lines, held = [], [], 0
        yield batch_of()

    names = files.select("file_path", "file_name").repartition(tasks)
    read = names.mapInArrow(rows, f"{_FILES}, line_no bigint, text binary")
    return read.withColumn("value", F.col("text").cast("string")).drop("text")


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``read_lines`` of a table of logs (file_path, file_name, file_size, as from ``list_files``), each opened once.

    No path of a small local file goes through the driver. Files that are large, packed or in another store are
    read as ``read_lines`` reads a list of paths.
    """
    files = files.select("file_path", "file_name", "file_size").dropDuplicates(["file_path"])
    whole = F.col("file_path").startswith("file:") & (F.col("file_size") <= WHOLE_FILE) & ~F.col("file_path").rlike(_PACKED)
    others = [r.file_path for r in files.filter(~whole).select("file_path").collect()]
    lines = staged(_whole_files(spark, files.filter(whole)), "raw-lines")
    return lines.unionByName(read_lines(spark, others)) if others else lines


def write_logs(lines: DataFrame, log: str, order: str, folder: str) -> None:
    """One more text file of ``value`` for each ``log``, its lines by ``order``, in the layout of ``partitionBy``.

    Spark creates a file on a local file system by way of two other processes (its rights, those of its checksum), unless
    Hadoop's native library is there; with a file a log that is all the time. There the tasks write the files
    themselves, each put in place whole, so that a repeated task replaces its own.
    """
    spark = lines.sparkSession
    dealt = lines.select(F.col(log).cast("string").alias(log), order, "value").repartition(log)
    dealt = dealt.sortWithinPartitions(log, order)
    files, place = hadoop_path(spark, folder)
    if files.getUri().getScheme() != "file":
        dealt.select(log, "value").write.mode("append").partitionBy(log).text(folder)
        return
    files.mkdirs(place)
    root, name = files.makeQualified(place).toUri().getPath(), f"part-{uuid.uuid4().hex}.txt"
    none = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of a log without a name

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, out, part, now = f".{name}-{uuid.uuid4().hex}", 0, None, "", None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(f"{part}/{own}", f"{part}/{name}")

        for batch in batches:
            keys, text = batch.column(0), batch.column(1).cast(pa.large_binary())
            if not len(keys):
                continue
            # the lines of a log lie side by side, so each run of a key is one piece of the batch's text
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data, runs = memoryview(text.buffers()[2] or b""), pc.run_end_encode(keys)
            since = 0
            for key, until in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if out is None or key != now:
                    close()
                    now, part, n = key, f"{root}/{log}={none if key is None else quote(key, safe='')}", n + 1
                    os.makedirs(part, exist_ok=True)
                    out = open(f"{part}/{own}", "wb")
                out.write(data[ends[since] : ends[until]])
                since = until
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    text = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary").alias("text")
    dealt.select(log, text).mapInArrow(write, "files long").agg(F.sum("files")).first()


def read_documents(spark: SparkSession, paths: str | list[str], *, glob: str | None = None) -> DataFrame:
    """Whole-document sources, one row per file: (file_path, file_name, file_modified_ns, value).

    For formats whose files are single JSON or HTML documents and cannot be split.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        (F.unix_micros("_metadata.file_modification_time") * 1000).alias("file_modified_ns"),
        "value",
    )


# Fixed patterns: where each tool keeps its logs below its home folder.
CLAUDE_FILES = r"/projects/[^/]+/([^/]+|[^/]+/subagents/[^/]+|[^/]+/subagents/workflows/[^/]+/[^/]+)\.jsonl$"
ROLLOUT_FILES = r"/(sessions/([^/]+/){0,3}[^/]+|archived_sessions/[^/]+)\.jsonl$"
GEMINI_FILES = r"/tmp/[^/]+/chats/session-[^/]*\.json$"
GROK_FILES = r"/(sessions|archived_sessions)/(.*/)?updates\.jsonl$"


def only_files(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(F.col("file_path").rlike(pattern))
