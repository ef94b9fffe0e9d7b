"""State of streams: exactly-once settling, the id index, changed keys alone."""

import re

import pytest
from pyspark.sql import functions as F

from tokentide.streaming import pipelines as S
from tokentide.streaming.tables import BETWEEN, BatchLog, Commits, VersionedTable

TURNS = "file_path string, line_no bigint, request_id string, created_at bigint"


def turns(spark, rows):
    return spark.createDataFrame(rows, TURNS)


@pytest.fixture
def tables(spark, tmp_path):
    schema = turns(spark, []).schema
    return lambda: (BatchLog(spark, str(tmp_path / "out"), schema), VersionedTable(spark, str(tmp_path / "pending"), schema))


def buckets_read(df):
    """Hash buckets that the scans of a plan are narrowed to."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = re.findall(r"PartitionFilters: (.*)", text)
    assert scans
    found = [set(re.findall(r"\d+", m)) for s in scans for m in re.findall(r"_bucket#\d+ (?:IN \(|INSET |= )([\d, ]+)", s)]
    assert len(found) == len(scans)
    return len(set().union(*found))


def emitted(tables):
    return sorted(r.request_id for r in tables()[0].read().collect())


def waiting(tables):
    return sorted(r.request_id for r in tables()[1].latest().collect())


class Killed(Exception):
    pass


def die_at(monkeypatch, owner, name, turn=1):
    """The n-th call of a method ends the run in its middle: its work is done, nothing after it."""
    real, calls = getattr(owner, name), []

    def dying(self, *args, **kw):
        calls.append(1)
        made = real(self, *args, **kw)
        if len(calls) == turn:
            raise Killed
        return made

    monkeypatch.setattr(owner, name, dying)


WRITES = [(BatchLog, "write_version", 1), (VersionedTable, "change_version", 1), (VersionedTable, "change_version", 2)]


@pytest.mark.parametrize("owner, name, turn", WRITES)
def test_a_sweep_that_died_emits_nothing(spark, tables, monkeypatch, owner, name, turn):
    """After each of its writes; then a batch, and another sweep."""
    S.settle_batch(*tables(), lambda: 1000)(turns(spark, [("f", 1, "a", 10), ("f", 2, "b", 900), ("g", 1, "c", 950)]), 0)
    assert (emitted(tables), waiting(tables)) == (["a"], ["b", "c"])
    with monkeypatch.context() as m:
        die_at(m, owner, name, turn)
        with pytest.raises(Killed):
            S.settle_sweep(*tables(), 5000)
    assert (emitted(tables), waiting(tables)) == (["a"], ["b", "c"])
    S.settle_batch(*tables(), lambda: 1501)(turns(spark, [("h", 1, "d", 1400)]), 1)
    assert (emitted(tables), waiting(tables)) == (["a", "b"], ["c", "d"])
    assert S.settle_sweep(*tables(), 5000)
    assert (emitted(tables), waiting(tables)) == (["a", "b", "c", "d"], [])


@pytest.mark.parametrize("owner, name, turn", [*WRITES, (Commits, "commit", 1)])
def test_a_batch_that_died_is_repeated_whole(spark, tables, monkeypatch, owner, name, turn):
    """Also with another clock, and with a sweep before its repeat."""
    first, second = turns(spark, [("f", 1, "a", 10), ("f", 2, "b", 900)]), turns(spark, [("f", 3, "c", 905), ("g", 1, "d", 20)])
    S.settle_batch(*tables(), lambda: 1000)(first, 0)
    with monkeypatch.context() as m:
        die_at(m, owner, name, turn)
        with pytest.raises(Killed):
            S.settle_batch(*tables(), lambda: 1500)(second, 1)
    if owner is not Commits:
        assert (emitted(tables), waiting(tables)) == (["a"], ["b"])
        assert S.settle_sweep(*tables(), 1501)
        assert (emitted(tables), waiting(tables)) == (["a", "b"], [])
    S.settle_batch(*tables(), lambda: 1502)(second, 1)
    S.settle_batch(*tables(), lambda: 1502)(second, 1)  # a committed batch, repeated
    assert S.settle_sweep(*tables(), 1600)
    assert (emitted(tables), waiting(tables)) == (["a", "b", "c", "d"], [])


def test_of_a_sweep_beside_a_batch_one_is_refused(spark, tables, monkeypatch):
    S.settle_batch(*tables(), lambda: 1000)(turns(spark, [("f", 1, "a", 900)]), 0)
    real = S.Settling.step

    def beside(self, now, batch, parent, version):
        if batch is None:  # the batch comes in between
            monkeypatch.setattr(S.Settling, "step", real)
            S.settle_batch(*tables(), lambda: 5000)(turns(spark, [("f", 2, "b", 1)]), 1)
        return real(self, now, batch, parent, version)

    monkeypatch.setattr(S.Settling, "step", beside)
    assert not S.settle_sweep(*tables(), 5000)
    assert (emitted(tables), waiting(tables)) == (["a", "b"], [])

    def swept(self, now, batch, parent, version):
        monkeypatch.setattr(S.Settling, "step", real)
        assert S.settle_sweep(*tables(), 9000)
        return real(self, now, batch, parent, version)

    S.settle_batch(*tables(), lambda: 6000)(turns(spark, [("g", 1, "c", 5900)]), 2)
    monkeypatch.setattr(S.Settling, "step", swept)
    S.settle_batch(*tables(), lambda: 9000)(turns(spark, [("g", 2, "d", 1)]), 3)
    assert (emitted(tables), waiting(tables)) == (["a", "b", "c", "d"], [])


def test_only_due_files_are_read(spark, tables):
    rows = [(f"f{i}", n, f"{i}-{n}", 1000 + i) for i in range(200) for n in (1, 2)]
    S.settle_batch(*tables(), lambda: 1100)(turns(spark, rows), 0)
    out, pending = tables()
    settling = S.Settling(out, pending, 600)
    assert settling.due.latest().count() == 200
    few = settling.due.latest().filter("due <= 1602")
    assert few.count() == 3
    assert 0 < buckets_read(pending.latest(only=few)) <= 3 < pending.facts()["buckets"]
    assert S.settle_sweep(out, pending, 1602)
    assert len(emitted(tables)) == 6 and len(waiting(tables)) == 394


def test_a_line_holds_back_the_later_ones(spark, tables):
    """Lines out of order, equal lines, lines without a number, a time or a file."""
    rows = [("f", 3, "c", 10), ("f", 2, "b", 990), (None, 1, "x", 999), ("g", None, "y", 999), ("h", 1, "z", None), ("f", 2, "b2", 10)]
    S.settle_batch(*tables(), lambda: 1000)(turns(spark, rows), 0)
    assert (emitted(tables), waiting(tables)) == (["x", "y", "z"], ["b", "b2", "c"])
    S.settle_batch(*tables(), lambda: 1001)(turns(spark, [("f", 1, "a", 1000)]), 1)
    S.settle_sweep(*tables(), 1590)  # b has left the window, a has not
    assert waiting(tables) == ["a", "b", "b2", "c"]
    S.settle_sweep(*tables(), 1600)
    assert waiting(tables) == []


def test_one_commit_follows_a_version(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "c"))
    assert commits.head() == -1
    assert commits.commit(-1, 0) and not commits.commit(-1, 7) and commits.head() == 0
    for v in range(0, 130):
        assert commits.commit(v, v + 1)
    oldest, listed = commits.holds()
    assert commits.head() == 130 and oldest == 30 and listed == set(range(30, 131))


def test_a_batch_number_that_was_passed_is_an_error(spark, tables):
    """A stream whose checkpoint was lost starts again with batch 0: that is told, not skipped."""
    S.settle_batch(*tables(), lambda: 1000)(turns(spark, [("f", 1, "a", 10)]), 3)
    with pytest.raises(ValueError, match="batch 1"):
        S.settle_batch(*tables(), lambda: 1000)(turns(spark, [("f", 2, "b", 10)]), 1)
    assert emitted(tables) == ["a"]


def test_hidden_versions_are_deleted(spark, tables):
    out, pending = tables()
    settling = S.Settling(out, pending, 600)
    out.write_version(5, turns(spark, [("f", 1, "a", 1)]))
    assert out.read().count() == 0
    for n in (1, 2):
        S.settle_batch(out, pending, lambda: 1000)(turns(spark, [("g", n, f"b{n}", 1)]), n)
    assert sorted(settling.out._named()) == [BETWEEN, 2 * BETWEEN]


# --- keyed state ---------------------------------------------------------------------------


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_batch_writes_its_changed_keys(spark, tmp_path):
    schema = "thread_id string, line_no bigint, input bigint, cached bigint, output bigint"
    out, state = BatchLog(spark, str(tmp_path / "o"), S.DELTA_ROWS), VersionedTable(spark, str(tmp_path / "s"), S.COUNTER_STATE)
    each = S.counter_batch(out, state)
    key = F.concat(F.lit("t"), F.col("id"))
    many = spark.range(100_000).select(key.alias("thread_id"), F.lit(1).cast("bigint").alias("line_no"), "id", "id", F.lit(5).cast("bigint")).toDF(*[c.split()[0] for c in schema.split(", ")])
    each(many, 0)
    whole = folder_bytes(tmp_path / "s")
    for n in range(1, 8):
        each(spark.createDataFrame([(f"t{i}", n + 1, 10**6 + n, 0, 9) for i in range(10)], schema), n)
    runs = {r.name: folder_bytes(tmp_path / "s" / r.name) for r in state._runs()}
    assert sum(runs.values()) - whole < 0.05 * whole
    assert len(runs) <= 5  # few, as equal ones are merged
    # of the buckets of ten threads alone
    few = spark.createDataFrame([(f"t{i}",) for i in range(10)], "thread_id string")
    assert 0 < buckets_read(state.latest(only=few)) <= 10 < state.facts()["buckets"]
    last = {r.thread_id: (r.line_no, r.input, r.events) for r in state.latest().filter("line_no > 1").collect()}
    assert last == {f"t{i}": (8, 10**6 + 7, 8) for i in range(10)} and state.latest().count() == 100_000
    assert out.read().count() == 100_000 + 70


def test_changes_equal_a_plain_table(spark, tmp_path):
    """Rows that change, go and come back, over merged runs, repeated batches and earlier versions."""
    schema = spark.createDataFrame([], "k bigint, v bigint, w string").schema
    table = VersionedTable(spark, str(tmp_path / "t"), schema).keyed(["k"], buckets=4)
    plain, versions = {}, {}
    for n in range(14):
        rows = [(k, n * 10 + k, None if k == 3 else f"{n}", (n + k) % 4 == 0) for k in range(n % 5, n % 5 + 6)]
        changed = spark.createDataFrame(rows, "k bigint, v bigint, w string, _gone boolean")
        for _ in range(1 + n % 2):
            table.change(n, changed)
        for k, v, w, gone in rows:
            plain.pop(k, None) if gone else plain.__setitem__(k, (v, w))
        versions[n] = dict(plain)
        fresh = VersionedTable(spark, str(tmp_path / "t"), schema)
        assert {r.k: (r.v, r.w) for r in fresh.latest().collect()} == plain
        assert {r.k: (r.v, r.w) for r in fresh.before(n).collect()} == versions.get(n - 1, {})
        some = spark.createDataFrame([(k,) for k in (1, 4)], "k bigint")
        part = {r.k: (r.v, r.w) for r in fresh.latest(only=some).collect()}
        assert part.items() <= plain.items() and {k for k in (1, 4) if k in plain} <= part.keys()
    table.write(14, spark.createDataFrame([(1, 2, "x")], schema))
    assert [tuple(r) for r in table.latest().collect()] == [(1, 2, "x")]


def test_only_the_buckets_of_a_batch_are_compared(spark, make_usage, tmp_path):
    log = S.usage_log(spark, str(tmp_path / "fact"))
    each = S.ingest_batch(log)
    each(make_usage([{"request_id": f"r{i}"} for i in range(3000)]), 0)
    batch = make_usage([{"request_id": f"r{i}"} for i in range(2990, 3005)])
    ids = S.id_index(log)
    assert 0 < buckets_read(ids.before(1, only=batch)) <= 15 < ids.facts()["buckets"]
    each(batch, 1)
    each(batch, 1)
    assert log.read().count() == 3005 and ids.latest().count() == 3005


def test_buckets_change_alone(spark, make_usage, tmp_path):
    """Update output stores the buckets that a micro-batch touches."""
    T0 = 1_700_000_000
    rows = make_usage([{"request_id": str(i), "created_at": T0 + 3600 * i} for i in range(500)])
    src, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "t"), S.live_buckets(rows).schema)

    def run(df):
        df.coalesce(1).write.mode("append").parquet(src)
        S.start(S.live_buckets(S.watch(spark, src, rows.schema)), S.change_table(table, ["bucket", "provider_name"]), str(tmp_path / "c"), mode="update").awaitTermination()

    run(rows)
    run(make_usage([{"request_id": "x", "created_at": T0}]))
    assert [spark.read.parquet(str(tmp_path / "t" / r.name)).count() for r in table._runs()] == [1, 500]
    want = {tuple(r) for r in S.live_buckets(spark.read.parquet(src)).collect()}
    assert {tuple(r) for r in table.latest().collect()} == want


def test_polling_goes_on_until_it_is_stopped(spark, make_usage, tmp_path):
    """The polling trigger takes what has landed since, without a restart."""
    src, log = str(tmp_path / "in"), S.usage_log(spark, str(tmp_path / "fact"))
    first = make_usage([{"request_id": "a"}])
    first.coalesce(1).write.mode("append").parquet(src)
    query = S.start(S.watch(spark, src, first.schema), S.ingest_batch(log), str(tmp_path / "c"), poll="200 milliseconds")
    try:
        query.processAllAvailable()
        assert log.read().count() == 1
        make_usage([{"request_id": "a"}, {"request_id": "b"}]).coalesce(1).write.mode("append").parquet(src)
        query.processAllAvailable()
        assert {r.request_id for r in log.read().collect()} == {"a", "b"} and query.isActive
    finally:
        query.stop()
