import random

import pytest
from pyspark.sql import functions as F

from tokentide.operators.ordered import running


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_running_equals_a_plain_scan(spark, chunk):
    rnd = random.Random(chunk)
    rows = []
    for key in ("a", "b", "hot"):
        places = sorted(rnd.sample(range(200), 20 if key != "hot" else 150))
        rows += [(key, n, rnd.choice([None, rnd.randrange(100)]), rnd.random() < 0.4) for n in places]
    expected = set()
    state = {}
    for key, n, v, hit in rows:
        seen, hits = state.get(key, (None, 0))
        hits += hit
        now = seen if v is None else v
        expected.add((key, n, now, seen, hits))
        state[key] = (now, hits)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n bigint, v int, hit boolean")
    out = running(
        df,
        ["k"],
        "n",
        last={"upto": F.col("v")},
        last_before={"before": F.col("v")},
        count={"hits": F.col("hit")},
        chunk_rows=chunk,
    )
    got = {(r.k, r.n, r.upto, r.before, r.hits) for r in out.collect()}
    assert got == expected
    assert out.columns == ["k", "n", "v", "hit", "upto", "before", "hits"]
