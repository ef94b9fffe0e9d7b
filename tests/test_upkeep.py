"""The maintained rollup, deep pages and deferred logs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tokentide.operators import analytics as A
from tokentide.operators.dedup import effective_usage
from tokentide.operators.merge import write_usage
from tokentide.operators import transfer
from tokentide.operators.transfer import read_documents, read_large_documents
from tokentide.plans.rollup import refresh_rollup, rollup_table

T = 1_700_000_000 - 1_700_000_000 % 86400


def cells(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_rollup_follows_the_fact_table(spark, make_usage, tmp_path):
    """Random increments, with late proxies, across midnight, and rows without a date; compared with folding everything."""
    rnd = random.Random(3)
    fact, table = str(tmp_path / "fact"), rollup_table(spark, str(tmp_path / "rollup"))
    for n in range(4):
        rows = []
        for i in range(60):
            source, app = rnd.choice([("codex_session", "codex"), ("session_log", "claude"), ("proxy", "codex"), ("proxy", "claude")])
            at = T + rnd.randrange(4) * 86400 + rnd.choice([5, 300, 86_000, 86_390]) if i else 1_800_000_000_000_000
            rows.append(dict(request_id=f"{n}-{i}", data_source=source, app_type=app, input_tokens=rnd.randrange(2), created_at=at))
        batch = make_usage(rows)
        write_usage(batch, fact)
        for _ in range(1 + n % 2):  # also a repeated batch
            refresh_rollup(table, spark.read.parquet(fact), batch, n)
        assert cells(table.latest()) == cells(A.daily_rollup(effective_usage(spark.read.parquet(fact))))
    assert table.latest().filter("date is null").count() >= 1


def test_rollup_reads_the_touched_days(spark, make_usage, tmp_path):
    place = str(tmp_path / "fact")
    write_usage(make_usage([dict(request_id=f"a{d}", created_at=T + d * 86400 + 40_000) for d in range(12)]), place)
    table = rollup_table(spark, str(tmp_path / "rollup"))
    refresh_rollup(table, spark.read.parquet(place), spark.read.parquet(place), 0)
    late = make_usage([dict(request_id="late", created_at=T + 6 * 86400 + 100)])
    write_usage(late, place)
    fact = spark.read.parquet(place)
    near = {str(r[0]) for r in spark.range(4, 8).select(F.expr(f"date_from_unix_date(cast({T // 86400} + id as int))")).collect()}
    for part in tmp_path.glob("fact/event_date=*/*.parquet"):
        if part.parent.name.removeprefix("event_date=") not in near:
            part.write_bytes(b"not a table")
    refresh_rollup(table, fact, late, 1)
    assert sorted(r.request_count for r in table.latest().collect()) == [1] * 11 + [2]


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_deep_pages_equal_plain_ones(make_usage, rows):
    rnd = random.Random(1)
    at = [T + rnd.choice([0, 0, 1, 59, 60, 3600, 90_000, 900_000]) for _ in range(90)]
    df = make_usage([{"request_id": f"r{i}", "created_at": t} for i, t in enumerate(at)]).cache()
    for page in (1, 2, 5, 9, 10):
        want = [r.request_id for r in A.request_log_page(df, page, 10).collect()]
        assert [r.request_id for r in A.request_log_deep(df, page, 10, rows=rows).collect()] == want


def test_a_deep_page_sorts_its_range(make_usage):
    df = make_usage([{"request_id": f"r{i:04}", "created_at": T + i * 40} for i in range(3000)]).cache()
    low, high, skip = A.page_range(df, 1500, 10, rows=200)
    inside = df.filter(F.col("created_at").between(low, high)).count()
    assert inside <= 200 and skip < 200
    assert A.page_range(df, 3000, 10) is None and A.page_range(df.filter("false"), 0, 10) is None


def document(rnd, n, **more):
    """A transfer with braces, quotes and backslashes in its texts, and values that no one reads."""
    odd = ['}', '{"records":[{', 'a"b', "\\\\", '\\"}', "é漢", "]}", "x" * 300, ""]
    records = [
        {"requestId": f"{n}-{i}", "providerId": rnd.choice(odd) + "p", "appType": "codex", "model": "m" + rnd.choice(odd), "inputTokens": i, "createdAt": T + i,
         "statusCode": 200, "errorMessage": rnd.choice(odd), "extra": {"a": [{"b": rnd.choice(odd)}], "c": {}}}
        for i in range(n)
    ]
    return {**more, "schemaVersion": 1, "note": rnd.choice(odd), "meta": {"records": [{"requestId": "no"}]}, "tags": [{"requestId": "no"}, "}"],
            "sourceDevice": {"id": "d" + str(n), "name": rnd.choice(odd)}, "records": records, "after": [{"requestId": "no"}, {"x": "]"}]}


def test_large_documents_equal_whole_ones(spark, tmp_path):
    rnd = random.Random(8)
    docs = [document(rnd, n) for n in (0, 1, 2, 40)] + [{"schemaVersion": 1, "records": [{"requestId": "z", "createdAt": 1}]}]
    docs += [{"a": [{"b": 1}], "records": [{"requestId": "y"}, {"requestId": "x"}], "c": [{"requestId": "no"}, {"requestId": "no"}], "schemaVersion": 1}]
    texts = [json.dumps(d, indent=i % 3 or None, ensure_ascii=bool(i % 2)) + " \n" * (i % 2) for i, d in enumerate(docs)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    want = sorted(map(str, read_documents(spark.createDataFrame([(t,) for t in texts], "value string")).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_large_documents(spark, str(tmp_path), chunk_rows=7)
        assert sorted(map(str, read.collect())) == want and len(want) == 46
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
        with pytest.raises(ValueError, match="too many"):
            read_large_documents(spark, str(tmp_path), max_records=39)
        (tmp_path / "old.json").write_text(json.dumps({**docs[1], "schemaVersion": 99}))
        with pytest.raises(ValueError, match="version"):
            read_large_documents(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_whole_records_of_large_documents_stay_where_they_are(spark, tmp_path, monkeypatch):
    kept = {}

    def watched(df, label):
        kept[label] = transfer_staged(df, label)
        return kept[label]

    transfer_staged = transfer.staged
    monkeypatch.setattr(transfer, "staged", watched)
    records = [{"requestId": f"r{i}", "model": "m}" if i == 50 else "m", "createdAt": i + 1} for i in range(100)]
    (tmp_path / "one.json").write_text(json.dumps({"schemaVersion": 1, "records": records}))
    rows = read_large_documents(spark, str(tmp_path)).collect()
    assert sorted(r.created_at for r in rows) == list(range(1, 101))
    # the opening piece, the two pieces of the record with a brace in it and the closing piece
    assert kept["document-pieces"].count() == 4
    assert not any("value" in df.columns for label, df in kept.items() if label != "document-pieces")
