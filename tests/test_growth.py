"""What keeps the time of large runs in proportion to their input."""

import re

from pyspark.sql import functions as F

from tokentide.operators.analytics import page_range
from tokentide.operators.dedup import drop_known
from tokentide.operators.merge import first_new, first_per_key
from tokentide.operators.ordered import running, wide_groups
from tokentide.operators.transfer import import_usage, read_documents
from tokentide.schema import TRANSFER_VERSION
from tokentide.sources.grok import grok_events
from tokentide.sources.rollouts import rollout_records
from tokentide.streaming import pipelines as S
from tokentide.streaming.tables import BatchLog, VersionedTable

#: Bytes of a method beyond which the JVM leaves it to its interpreter.
HUGE_METHOD = 8000


def method_sizes(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_parsing_of_rollouts_is_compiled(spark, make_lines):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = method_sizes(rollout_records(make_lines({"/a.jsonl": ["{}"]})))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < HUGE_METHOD


def test_only_groups_of_several_ranges_are_summarised(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("g"), "id", F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))
    rows = rows.filter("g < 2 or id < 10")
    wide = wide_groups(rows, "g", "id", 10)
    assert sorted(r.g for r in wide.collect()) == [0, 1]
    scan = dict(last={"a": F.col("v")}, last_before={"b": F.col("v")}, count={"n": F.lit(True)}, peak_before={"p": F.col("v")}, chunk_rows=10)
    plain = running(rows, ["g"], "id", **scan)
    assert sorted(running(rows, ["g"], "id", wide=wide, **scan).collect()) == sorted(plain.collect())
    # no group has two ranges: nothing is joined
    short = running(rows, ["g"], "id", wide=wide_groups(rows, "g", "id", 100), **{**scan, "chunk_rows": 100})
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(short.collect()) == sorted(plain.collect())


def test_rows_are_read_once_to_find_a_page(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(2000).select((1_700_000_000 + F.col("id") * 37).alias("created_at")).mapInArrow(seen, "created_at bigint")
    low, high, skip = page_range(rows, 1500, 10, rows=1)
    assert (low, high, skip) == (1_700_000_000 + 490 * 37, 1_700_000_000 + 499 * 37, 0)
    assert read.value == 2000


def test_transfer_documents_are_made_once(spark, make_usage):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    record = '{"requestId": "r%d", "providerId": "p", "appType": "claude", "model": "m", "createdAt": 5}'
    head = f'{{"schemaVersion": {TRANSFER_VERSION}, "sourceDevice": {{"id": "d", "name": "D"}}, "records": '
    texts = [head + "[" + record % 1 + "," + record % 2 + "]}", head + "[]}", head + "[" + record % 3 + "]}"]
    documents = spark.createDataFrame([(t,) for t in texts], "value string").mapInArrow(seen, "value string")
    rows = import_usage(read_documents(documents), make_usage([{"request_id": "r2"}]))
    assert sorted((r.request_id, r.device_id) for r in rows.collect()) == [("r1", "d"), ("r3", "d")]
    assert made.value == 3


def test_turns_of_short_logs_are_numbered_without_a_join(make_lines):
    turn = '{"timestamp": 5, "method": "_x.ai/session/update", "params": {"update": {"sessionUpdate": "turn_completed", "usage": {}}}}'
    lines = make_lines({"/s/a/updates.jsonl": [turn] * 5})
    short, long = grok_events(lines), grok_events(lines, chunk_rows=2)
    assert "Join" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.event_no for r in short.collect()) == sorted(r.event_no for r in long.collect()) == [0, 1, 2, 3, 4]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_rows_are_the_first_of_each_unknown_key(spark):
    keys = ["a", "b", "b", "c", "d", "d", None, None, "e"]
    rows = spark.createDataFrame([(k, i % 4, f"p{i}") for i, k in enumerate(keys)], "request_id string, created_at bigint, provider_id string")
    for known in ([], ["c", "d", "z"], ["c", None], ["a", "b", "c", "d", "e"]):
        stored = spark.createDataFrame([(k,) for k in known], "request_id string")
        order = F.col("created_at"), F.col("provider_id")
        plain = first_per_key(drop_known(rows, stored), ["request_id"], *order)
        new = first_new(rows, stored, "request_id", *order)
        assert new.columns == rows.columns
        assert sorted(map(repr, new.collect())) == sorted(map(repr, plain.collect()))


def test_rows_that_come_once_are_not_sorted_to_be_stored(spark, make_usage, tmp_path, monkeypatch):
    plans, real = [], BatchLog.write_version
    monkeypatch.setattr(BatchLog, "write_version", lambda log, version, df: (plans.append(plan(df)), real(log, version, df)))
    log = S.usage_log(spark, str(tmp_path / "fact"))
    each = S.ingest_batch(log)
    each(make_usage([{"request_id": f"r{i}"} for i in range(50)]), 0)
    each(make_usage([{"request_id": f"r{i}", "output_tokens": 7} for i in (3, *range(40, 60), 59)]), 1)
    assert not any("SortMergeJoin" in p for p in plans)
    assert log.read().count() == 60 and log.read().filter("output_tokens = 7").count() == 10


def test_a_dated_batch_is_written_in_few_files(spark, make_usage, tmp_path):
    log = S.usage_log(spark, str(tmp_path / "fact"))
    rows = make_usage([{"request_id": f"r{i}", "created_at": 1_700_000_000 + i % 5 * 86400} for i in range(400)])
    log.write(0, rows.repartition(8))
    assert log.read().count() == 400
    assert len(log.read().inputFiles()) == 5


def test_changes_of_fixed_width_are_merged_by_hash(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), spark.range(0).selectExpr("string(id) AS k", "id AS v").schema).keyed(["k"], buckets=2)
    table.change(0, spark.range(100).selectExpr("string(id) AS k", "id AS v"))
    gone = spark.range(10).selectExpr("string(id) AS k", "if(id < 5, null, -id) AS v", "id = 7 AS _gone")
    table.change(1, gone)
    now = table.latest()
    assert "SortAggregate" not in plan(now) and "HashAggregate" in plan(now)
    got = {r.k: r.v for r in now.collect()}
    assert len(got) == 99 and "7" not in got and got["3"] is None and got["8"] == -8 and got["50"] == 50


def test_columns_are_completed_for_kept_rows_alone(spark, make_usage, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    price = lambda rows: rows.mapInArrow(seen, rows.schema).withColumn("total_cost_usd", F.col("output_tokens") * 2)
    log = S.usage_log(spark, str(tmp_path / "fact"))
    each = S.ingest_batch(log, lambda batch: batch.drop("total_cost_usd"), complete=price)
    each(make_usage([{"request_id": f"r{i}", "output_tokens": i} for i in (1, 2, 2, 3)]), 0)
    each(make_usage([{"request_id": f"r{i}", "output_tokens": i} for i in (1, 2, 3, 4)]), 1)
    assert {r.request_id: int(r.total_cost_usd) for r in log.read().collect()} == {"r1": 2, "r2": 4, "r3": 6, "r4": 8}
    assert made.value == 4
