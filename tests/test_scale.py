"""Plans and state that have to hold on a cluster: what is read, moved, kept and refused."""

import datetime as dt
import json
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tokentide import session
from tokentide.operators import analytics as A, pricing as P
from tokentide.operators.dedup import drop_near_activity, ingest_dedup
from tokentide.operators.filters import UsageQuery, in_range
from tokentide.operators.merge import first_per_key, rewrite_days, upsert, write_usage
from tokentide.operators.replay import resolve_parents
from tokentide.operators.transfer import read_documents
from tokentide.plans import sync as Y
from tokentide.plans.refresh import refresh_prices
from tokentide.plans.report import usage_report
from tokentide.schema import CURSOR_SCHEMA
from tokentide.sources import landed as L
from tokentide.sources.claude import claude_usage
from tokentide.sources.lines import list_files, read_lines, write_logs
from tokentide.sources.opencode import opencode_usage
from tokentide.sources.rollouts import classify_threads, rollout_records
from tokentide.streaming import pipelines as S
from tokentide.streaming.tables import BatchLog, VersionedTable

from workload.views import spread

from .test_replay import meta, path, uid
from .test_sources import turn

NOW = 1_800_000_000
T = 1_700_000_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- folders ---------------------------------------------------------------------


def test_a_cluster_needs_the_shared_folder():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(cluster)
    one = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", applicationId="b"))
    assert session.work_dir(one) == session.work_dir(one)


def test_staged_tables_go_with_their_scope(spark):
    with session.staging(spark):
        inside = session.staged(spark.range(3).toDF("a"), "scope")
        assert inside.count() == 3
        files = inside.inputFiles()
    outside = session.staged(spark.range(3).toDF("a"), "scope")
    assert outside.count() == 3
    store, place = session.hadoop_path(spark, files[0])
    assert not store.exists(place)


# --- limits ------------------------------------------------------------------------


def test_pages_are_refused_not_cut(make_usage):
    df = make_usage([{"request_id": f"{i:03}"} for i in range(150)])
    with pytest.raises(ValueError, match="at most 100"):
        A.request_log_page(df, 1, 101)
    assert A.request_log_page(df, 1, 120, max_size=200).count() == 120
    assert A.request_log_after(df, T, "", 150, max_size=200).count() == 150


def test_transfers_have_no_limit_unless_given(spark):
    record = {"requestId": "q", "providerId": "_s", "appType": "codex", "model": "m", "createdAt": T}
    doc = json.dumps({"schemaVersion": 1, "sourceDevice": {"id": "d", "name": "D"}, "records": [record] * 7})
    df = spark.createDataFrame([(doc,)], "value string")
    assert read_documents(df).count() == 7
    with pytest.raises(ValueError, match="too many"):
        read_documents(df, max_records=6)
    with pytest.raises(ValueError, match="too large"):
        read_documents(df, max_bytes=10)


# --- bad input -----------------------------------------------------------------------


def test_huge_counts_and_costs_do_not_stop_a_run(spark, make_lines):
    lines = make_lines({"/projects/p/a.jsonl": [turn("a", input_tokens=10**13), turn("b", input_tokens=10**30, output=10**15)]})
    rows = {r.request_id: r for r in P.price_usage(claude_usage(lines, NOW), P.seed_prices(spark)).collect()}
    assert rows["session:a"].input_tokens == rows["session:b"].output_tokens == 4294967295
    data = json.dumps({"role": "assistant", "modelID": "gpt-5", "cost": 1e12, "tokens": {"input": 10**14}, "time": {"created": 1, "completed": 1}})
    df = spark.createDataFrame([("m", "s", 1, data)], "id string, session_id string, time_created bigint, data string")
    (one,) = P.price_usage(opencode_usage(df, NOW), P.seed_prices(spark)).collect()
    assert one.input_tokens == 4294967295 and one.total_cost_usd == one.input_cost_usd > 0


def test_empty_documents_are_errors(spark, make_usage):
    empty = L.price_catalog(spark.createDataFrame([('{"data":[]}',)], "value string"))
    with pytest.raises(ValueError, match="no entries"):
        refresh_prices(make_usage([{}]), P.seed_prices(spark), empty, 5)
    with pytest.raises(ValueError, match="no valid"):
        L.read_benchmark(spark.createDataFrame([('{"points":[{"model":"m"}]}',)], "value string"))
    pages = spark.createDataFrame([(1, '<section class="quota-radar">nothing</section>')], "page_id int, html string")
    sections = L.quota_sections(pages, "page_id")
    assert sections.count() == 1 and L.complete_sections(sections).count() == 0


def test_report_without_a_range(make_usage):
    report = usage_report(make_usage([{"created_at": T}, {"created_at": T + 3 * 86400}]), UsageQuery())
    assert report["chart"].count() == 4 and report["log_total"].first().total == 2
    assert usage_report(make_usage([{}]).filter("false"), UsageQuery())["summary"].first().total_requests == 0


# --- plans -----------------------------------------------------------------------------


def test_prices_do_not_move_the_usage(spark, make_usage, tmp_path):
    place = str(tmp_path / "usage")
    make_usage([{"model": m} for m in ("gpt-5", "x", "gpt-5-20250807")]).write.parquet(place)
    df = P.recost(spark.read.parquet(place), P.seed_prices(spark))
    text = plan(df)
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 2
    assert not re.search(r"Exchange hashpartitioning\(_(exact|undated)_key#\d+, \d+\), ENSURE_REQUIREMENTS.*\n.*model#", text)


def test_reports_group_by_what_they_answer(make_usage):
    df = make_usage([{}])
    assert "effective" not in plan(A.provider_stats(df)) and "date_format" not in plan(A.provider_stats(df))
    for report in (A.provider_stats(df), A.model_stats(df)):
        assert len(re.findall(r"Exchange hashpartitioning", plan(report))) == 1
    assert "SinglePartition" not in plan(A.cost_shares(A.cube(df, False)))


def test_ingest_reads_the_days_around_the_batch(spark, make_usage, tmp_path):
    place = str(tmp_path / "fact")
    write_usage(make_usage([dict(request_id=f"p{i}", data_source="proxy", created_at=T + i * 86400) for i in range(9)]), place)
    fact = spark.read.parquet(place)
    batch = make_usage([dict(created_at=T + 4 * 86400 + 5)])
    for out in (ingest_dedup(batch, fact), drop_near_activity(batch, fact, "claude")):
        assert "PartitionFilters: [isnotnull(event_date" in plan(out)
        assert out.count() == 0
    assert ingest_dedup(batch.filter("false"), fact).count() == 0


@pytest.mark.parametrize("odd", [1_800_000_000_000_000, -1_800_000_000_000_000, 1_700_000_000_000])
def test_a_time_without_a_date_hides_no_proxy(spark, make_usage, tmp_path, odd):
    """One session row in nanoseconds or microseconds, in a batch over a table stored by day."""
    place = str(tmp_path / "fact")
    proxies = [dict(request_id=f"p{i}", data_source="proxy", created_at=T + i * 86400) for i in range(3)]
    write_usage(make_usage([*proxies, dict(request_id="far", data_source="proxy", created_at=odd)]), place)
    fact = spark.read.parquet(place)
    batch = make_usage([dict(request_id="twin", created_at=T + 5), dict(request_id="own", created_at=T + 5000), dict(request_id="odd", created_at=odd + 5)])
    for out in (ingest_dedup(batch, fact), drop_near_activity(batch, fact, "claude")):
        assert [r.request_id for r in out.select("request_id").collect()] == ["own"]
    found = lambda start, end: {r.request_id for r in in_range(fact, start, end).select("request_id").collect()}
    early, late = ({"far"}, set()) if odd < 0 else (set(), {"far"})
    assert found(T, None) == {"p0", "p1", "p2"} | late and found(None, T) == {"p0"} | early
    assert found(T, T + 86400) == {"p0", "p1"}


def test_an_outlying_time_reads_its_own_days(spark, make_usage, tmp_path):
    """A batch with one row of 1970: every stored day that holds no neighbour is made unreadable."""
    place = str(tmp_path / "fact")
    at = [5, 86_400 * 300, *(T + i * 86400 for i in range(9))]
    write_usage(make_usage([dict(request_id=f"p{i}", data_source="proxy", created_at=t, output_tokens=1) for i, t in enumerate(at)]), place)
    fact = spark.read.parquet(place)
    batch = make_usage([dict(request_id=f"b{n}", created_at=t, output_tokens=1) for n, t in enumerate([10, T + 4 * 86400 + 5, T + 4 * 86400 + 5000])])
    needed = {"1970-01-01", "1969-12-31", *(str(day.date()) for day in map(lambda t: dt.datetime.fromtimestamp(t, dt.UTC), (T + 4 * 86400, T + 4 * 86400 + 5600)))}
    for part in tmp_path.glob("fact/event_date=*/*.parquet"):
        if part.parent.name.removeprefix("event_date=") not in needed:
            part.write_bytes(b"not a table")
    known = fact.select("request_id").limit(0)
    for out in (ingest_dedup(batch, fact, known), drop_near_activity(batch, fact, "claude")):
        assert "dynamicpruning" in plan(out)
        assert [r.request_id for r in out.select("request_id").collect()] == ["b2"]


def test_rows_without_a_date_are_rewritten(spark, make_usage, tmp_path):
    place = str(tmp_path / "fact")
    write_usage(make_usage([dict(request_id=i, created_at=at) for i, at in (("a", T), ("b", 1_800_000_000_000_000))]), place)
    rewrite_days(spark.read.parquet(place).withColumn("model", F.lit("new")), F.col("request_id") == "b", place)
    assert {r.request_id: r.model for r in spark.read.parquet(place).collect()} == {"a": "m", "b": "new"}


def test_full_ties_fall_the_same_way(make_usage):
    df = make_usage([{"request_id": "a", "output_tokens": n} for n in range(20)])
    picks = {first_per_key(d, ["request_id"], F.col("created_at")).first().output_tokens for d in (df, df.repartition(7), df.coalesce(1))}
    assert len(picks) == 1


# --- files ---------------------------------------------------------------------------------


def test_unchanged_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "projects"
    folder.mkdir()
    (folder / "a.jsonl").write_text(turn("1") + "\n" + turn("2") + "\n")
    (folder / "b.jsonl").write_text(turn("3") + "\n")
    opened = []

    def read(spark, paths):
        opened.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return read_lines(spark, paths)

    def run(cursors):
        return Y.sync_files(spark, list_files(spark, str(folder), glob="*.jsonl"), cursors, read, Y.sync_claude, NOW)

    rows, changes = run(spark.createDataFrame([], CURSOR_SCHEMA))
    assert rows.count() == 3
    cursors = session.staged(changes, "cursors")
    (folder / "c.jsonl").write_text(turn("4") + "\n")
    rows, changes = run(cursors)
    assert [r.request_id for r in rows.collect()] == ["session:4"]
    assert opened == [["a.jsonl", "b.jsonl"], ["c.jsonl"]]
    cursors = session.staged(upsert(cursors, changes, ["file_path"]), "cursors")
    assert run(cursors) is None


def test_line_numbers_move_no_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x\ny\n")
    df = read_lines(spark, str(tmp_path))
    assert "BroadcastHashJoin" in plan(df) and "hashpartitioning" not in plan(df)
    assert sorted((r.line_no, r.value) for r in df.collect()) == [(1, "x"), (2, "y")]


def test_rollouts_open_changed_logs_and_their_parents(spark, tmp_path, make_lines):
    folder = tmp_path / "sessions"
    folder.mkdir()
    texts = {1: [meta(1)], 2: [meta(2, forked_from_id=uid(1))], 3: [meta(3)]}
    for n, lines in texts.items():
        (folder / path(n).rsplit("/", 1)[1]).write_text("\n".join(lines) + "\n")
    files = list_files(spark, str(folder))
    pending = spark.createDataFrame([], "file_path string, pending string, parent_id string, file_modified_ns bigint, file_size bigint")
    seen = files.filter(~F.col("file_path").contains(uid(2))).select("file_path", F.col("file_modified_ns").alias("last_modified"), F.lit(1).cast("bigint").alias("last_line_offset"), F.lit(1).cast("bigint").alias("last_synced_at"))
    got = Y.rollout_paths(spark, files, seen, pending, read_lines)
    assert len(got) == 2 and uid(1) in got[0] and uid(2) in got[1]


def test_parent_ids_without_hyphens(make_lines):
    lines = make_lines({path(2): [json.dumps({"type": "session_meta", "payload": {"id": uid(2), "forked_from_id": uid(1).replace("-", "")}})]})
    (r,) = classify_threads(rollout_records(lines)).collect()
    assert (r.parent_status, r.parent_id) == ("parent", uid(1))


def test_copies_are_compared_once_for_all_forks(spark):
    """Three copies' states: equal, different from an event on, and the same event at two times."""
    logs = {("a", 1): [(0, "x"), (10, "y"), (20, "z")], ("b", 1): [(0, "x"), (10, "y"), (20, "q")], ("c", 2): [(0, "x"), (10, "y"), (30, "z")], ("d", 2): [(0, "x"), (15, "y"), (30, "z")]}
    rows = [(f, f"t{t}", n, s, sig) for (f, t), events in logs.items() for n, (s, sig) in enumerate(events)]
    records = spark.createDataFrame(rows, "file_path string, thread_id string, line_no bigint, s bigint, signature string").selectExpr(
        "file_path", "thread_id", "line_no", "timestamp_seconds(1700000000 + s) AS ts", "signature", "'token' AS kind"
    )
    forks = {"k0": ("t1", 15), "k1": ("t1", 20), "k2": ("t2", 9), "k3": ("t2", 12), "k4": ("t2", 15)}
    children = spark.createDataFrame(
        [(c, c, p, T + s) for c, (p, s) in forks.items()], "file_path string, thread_id string, parent_id string, s bigint"
    ).selectExpr("file_path", "thread_id", "parent_id", "timestamp_seconds(s) AS fork_ts", "'parent' AS parent_status", "cast(null as string) AS reason")
    got = {r.file_path: r.pending_reason for r in resolve_parents(children, records).collect()}
    unequal = {c for c, r in got.items() if r == "copies of the parent differ"}
    assert unequal == {"k1", "k3"}


# --- streams ---------------------------------------------------------------------------------


def test_settled_without_a_new_file_and_after_a_restart(spark, tmp_path):
    schema = spark.createDataFrame([], "file_path string, line_no bigint, request_id string, created_at bigint").schema
    tables = lambda: (BatchLog(spark, str(tmp_path / "o"), schema), VersionedTable(spark, str(tmp_path / "p"), schema))
    S.settle_sweep(*tables(), 5)  # nothing there yet
    out, pending = tables()
    S.settle_batch(out, pending, lambda: 1000)(spark.createDataFrame([("f", 1, "a", 10), ("f", 2, "b", 900)], schema), 0)
    out, pending = tables()
    assert [r.request_id for r in pending.latest().collect()] == ["b"]
    S.settle_sweep(out, pending, 1100)
    assert out.read().count() == 1
    S.settle_sweep(out, pending, 5000)
    out, pending = tables()
    assert {r.request_id for r in out.read().collect()} == {"a", "b"} and pending.latest().count() == 0
    S.settle_batch(out, pending, lambda: 9000)(spark.createDataFrame([("f", 3, "c", 10)], schema), 1)
    assert sorted(r.request_id for r in out.read().collect()) == ["a", "b", "c"]


def test_old_versions_go(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), spark.range(1).schema)
    for batch in range(4):
        table.write(batch, spark.range(batch))
    assert table.latest().count() == 3 and table.before(3).count() == 2
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]) == 2


def test_a_broken_log_is_an_error(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), spark.range(1).schema)
    assert log.read().count() == 0
    log.write(0, spark.range(2))
    (tmp_path / "log" / "batch=0" / "part-9.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception, match="part-9"):
        log.read().count()


def test_late_lines_are_kept_apart(spark, tmp_path):
    schema = spark.createDataFrame([], "thread_id string, line_no bigint, input bigint, cached bigint, output bigint").schema
    out, state = BatchLog(spark, str(tmp_path / "o"), S.DELTA_ROWS), VersionedTable(spark, str(tmp_path / "s"), S.COUNTER_STATE)
    late = BatchLog(spark, str(tmp_path / "l"), schema)
    each = S.counter_batch(out, state, late=late)
    each(spark.createDataFrame([("t", 5, 10, 0, 0)], schema), 0)
    each(spark.createDataFrame([("t", 4, 3, 0, 0), ("t", 6, 12, 0, 0)], schema), 1)
    assert [r.line_no for r in late.read().collect()] == [4]
    assert sorted(r.input_tokens for r in out.read().collect()) == [2, 10]




def test_each_rollout_log_is_read_once(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    for n, lines in {1: [meta(1)], 2: [meta(2, forked_from_id=uid(1))], 3: [meta(3)]}.items():
        (folder / path(n).rsplit("/", 1)[1]).write_text("\n".join(lines) + "\n")
    files = list_files(spark, str(folder))
    seen = files.filter(~F.col("file_path").contains(uid(2))).select("file_path", F.col("file_modified_ns").alias("last_modified"), F.lit(1).cast("bigint").alias("last_line_offset"), F.lit(1).cast("bigint").alias("last_synced_at"))
    opened = []

    def read(spark, paths):
        opened.extend(p[-9:-6] for p in paths)
        return read_lines(spark, paths)

    rows, changes, pending = Y.sync_rollout_files(spark, files, seen, spark.createDataFrame([], Y.PENDING), read, NOW)
    assert opened == [uid(2)[-3:], uid(1)[-3:]]
    assert [r.file_path[-9:-6] for r in changes.collect()] == [uid(2)[-3:]]


def test_lines_of_listed_logs_come_from_staged_text(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text(f"{name}1\n{name}2\n")
    lines = read_lines(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert "FileScan text" not in plan(lines)
    assert sorted((r.file_name, r.line_no, r.value) for r in lines.collect()) == [(f"{n}.jsonl", i, f"{n}{i}") for n in "ab" for i in (1, 2)]


def test_logs_are_written_one_file_each(spark, tmp_path):
    lines = spark.range(60_000).selectExpr("id % 3 AS user", "60000 - id AS line_no", "concat('é ', id, '  ') AS value")
    folder = str(tmp_path / "logs")
    write_logs(lines, "user", "line_no", folder)
    write_logs(lines.filter("user = 1"), "user", "line_no", folder)
    names = sorted(str(p.parent.name) for p in (tmp_path / "logs").rglob("*") if p.is_file())
    assert names == ["user=0", "user=1", "user=1", "user=2"]  # no checksum files either
    want = [f"é {i}  " for i in range(59_999, -1, -1) if i % 3 == 2]
    (only,) = (tmp_path / "logs" / "user=2").iterdir()
    assert only.read_text().split("\n") == [*want, ""]
    conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(conf)
    files = list_files(spark, folder, glob="*.txt")
    assert files.count() == 4 and spark.conf.get(conf) == before


def test_a_table_in_one_file_is_spread(spark, tmp_path):
    spark.range(300_000).selectExpr("id AS event_id", "uuid() AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    folder = spread(spark, str(tmp_path), "events", "event_id")
    rows = spark.read.parquet(f"{folder}/events.parquet")
    assert len(rows.inputFiles()) > 1
    assert rows.exceptAll(spark.read.parquet(str(tmp_path / "events.parquet"))).isEmpty() and rows.count() == 300_000


def test_a_large_batch_is_not_made_to_find_its_buckets(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "ids"), spark.range(0).selectExpr("id AS request_id").schema).keyed(["request_id"], buckets=4)
    table.change(0, spark.range(100).selectExpr("id AS request_id"))
    late = "if(id < 50000, id, cast(raise_error('made whole') as bigint))"
    batch = spark.range(0, 100_000, 1, 4).selectExpr(f"{late} AS request_id")
    assert table.latest(only=batch).count() == 100
    few = spark.range(1).selectExpr("id AS request_id")
    assert 0 < table.latest(only=few).count() < 100 and table.latest(only=few.limit(0)).count() == 0


def test_price_changes_are_matched_before_the_upsert(spark, make_usage):
    entry = {"id": "lab/new-model", "name": "New", "pricing": {"prompt": "0.000001", "completion": "0.000002"}}
    cat = L.price_catalog(spark.createDataFrame([(json.dumps({"data": [entry]}),)], "value string"))
    out = P.refreshed_prices(make_usage([dict(model="NEW-MODEL")]), P.seed_prices(spark).limit(1), cat, 5)
    assert "Generate explode" not in plan(out)
    assert [r.model_id for r in out.filter("price_fetched_at = 5").collect()] == ["NEW-MODEL"]
