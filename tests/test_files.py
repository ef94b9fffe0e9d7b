"""Lists of files and small logs, made and read by tasks: the same rows as by Spark's own file index and reader."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tokentide.plans import sync as Y
from tokentide.schema import CURSOR_SCHEMA
from tokentide.session import staged
from tokentide.operators.merge import upsert
from tokentide.sources import lines as L

from .test_replay import meta, path, token, uid
from .test_sources import turn

NOW = 1_800_000_000
TEXT = b"\xef\xbb\xbfone\r\ntwo\rthree\n\nbad\xff\nlast"


@pytest.fixture
def tree(tmp_path):
    for folder in ("", "user=1", "a b/c%41/é", "_skip", "_k=1", ".hid"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for name in ("x.txt", "q [1]{2}.txt", "_n.txt", "_k=v.txt", ".dot.txt", "x.txt._COPYING_", "other.log"):
            (tmp_path / folder / name).write_bytes(TEXT)
        (tmp_path / folder / "empty.txt").touch()
    for n in range(100):
        (tmp_path / "many" / f"u={n}").mkdir(parents=True)
        (tmp_path / "many" / f"u={n}" / "p.txt").write_text(f"{n}\n{n}\n")
    os.symlink(tmp_path / "x.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "nothing", tmp_path / "broken.txt")
    return tmp_path


def rows(df):
    return sorted(map(tuple, df.withColumns({c: F.col(c).cast("binary") for c in df.columns if c == "value"}).collect()))


@pytest.mark.parametrize("glob", [None, "*.txt", "{x,o}*.[lt]*"])
def test_lists_what_spark_lists(spark, tree, glob, monkeypatch):
    paths = [str(tree), str(tree / "many"), str(tree / "x.txt")]
    got = [rows(L.list_files(spark, p, glob=glob)) for p in (paths[0], paths, paths[2])]
    monkeypatch.setattr(L, "_local", lambda *a: None)
    assert got == [rows(L.list_files(spark, p, glob=glob)) for p in (paths[0], paths, paths[2])]
    assert got[0] and got[0] == got[1]


def test_list_stays_as_it_was_and_is_read_by_few_tasks(spark, tree):
    files = L.list_files(spark, str(tree / "many"))
    (tree / "many" / "u=0" / "later.txt").write_text("x\n")
    assert files.count() == 100 and files.rdd.getNumPartitions() <= 8


def test_reads_what_spark_reads(spark, tree):
    files = L.list_files(spark, str(tree), glob="*.txt").filter(~F.col("file_path").contains("%"))
    want = L.read_lines(spark, [r.file_path for r in files.collect()])
    got = L.read_files(spark, files)
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want)


def test_names_that_need_quotes(spark, tree):
    files = L.list_files(spark, str(tree / "a b")).filter(F.col("file_name").startswith("q"))
    got = rows(L.read_files(spark, files).select("line_no", "value"))
    assert got == [(1, b"one"), (2, b"two"), (3, b"three"), (4, b""), (5, b"bad\xff"), (6, b"last")]


def test_large_and_packed_logs_are_read_by_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "WHOLE_FILE", 10)
    (tmp_path / "large.txt").write_text("".join(f"line {n}\n" for n in range(50)))
    (tmp_path / "small.txt").write_text("a\nb\n")
    (tmp_path / "p.gz").write_bytes(gzip.compress(b"c\n"))
    got = L.read_files(spark, L.list_files(spark, str(tmp_path)))
    assert sorted((r.file_name, r.line_no, r.value) for r in got.collect()) == sorted(
        [("large.txt", n + 1, f"line {n}") for n in range(50)] + [("small.txt", 1, "a"), ("small.txt", 2, "b"), ("p.gz", 1, "c")]
    )


def test_pass_takes_changed_files_as_a_table(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(turn("1") + "\n")
    opened = []

    def read(session, files):
        opened.append(sorted(r.file_name for r in files.collect()))
        return L.read_files(session, files)

    def run(cursors):
        return Y.sync_files(spark, L.list_files(spark, str(tmp_path)), cursors, read, Y.sync_claude, NOW, by_table=True)

    rows_, changes = run(spark.createDataFrame([], CURSOR_SCHEMA))
    cursors = staged(upsert(spark.createDataFrame([], CURSOR_SCHEMA), changes, ["file_path"]), "cursors")
    (tmp_path / "b.jsonl").write_text(turn("2") + "\n")
    assert [r.request_id for r in rows_.collect()] == ["session:1"]
    assert [r.request_id for r in run(cursors)[0].collect()] == ["session:2"]
    assert opened == [["a.jsonl"], ["b.jsonl"]]
    os.remove(tmp_path / "b.jsonl")
    assert run(cursors) is None


def test_written_logs_hold_their_lines(spark, tmp_path):
    lines = spark.createDataFrame([(u, n, f"{u} é {n}") for u in ("a/b", "c") for n in range(30)] + [(None, 1, "x"), ("c", 30, "")], "user string, line_no int, value string")
    L.write_logs(lines, "user", "line_no", str(tmp_path / "logs"))
    got = {f.rsplit("/", 1)[1]: open(next(e.path for e in os.scandir(f)), encoding="utf-8").read() for f in (e.path for e in os.scandir(tmp_path / "logs"))}
    assert got == {
        "user=a%2Fb": "".join(f"a/b é {n}\n" for n in range(30)),
        "user=c": "".join(f"c é {n}\n" for n in range(30)) + "\n",
        "user=__HIVE_DEFAULT_PARTITION__": "x\n",
    }


def test_rollout_pass_joins_lines_with_left_out_logs_only(spark, make_lines, monkeypatch):
    """Lines are told apart by file: with every log wanted their text goes into no join."""
    tables, plans = Y.rollout_tables, []

    def noted(lines, *args):
        plans.append(lines._jdf.queryExecution().optimizedPlan().toString())
        return tables(lines, *args)

    monkeypatch.setattr(Y, "rollout_tables", noted)
    logs = {path(1): [meta(1), token((5, 0, 0), second=1)], path(2): [meta(2), token((7, 0, 0), second=1)]}
    lines = staged(make_lines(logs).withColumn("file_modified_ns", F.lit(5).cast("bigint")), "lines")
    none = spark.createDataFrame([], CURSOR_SCHEMA)
    got, changes, _ = Y.sync_rollouts(lines, none, NOW)
    assert "Join" not in plans[0] and got.count() == 2
    seen = staged(changes.filter(F.col("file_path") == path(1)), "cursors")
    got, changes, threads = Y.sync_rollouts(lines, seen, NOW)
    assert "Join" in plans[1]
    assert [r.file_path for r in got.collect()] == [r.file_path for r in changes.collect()] == [r.file_path for r in threads.collect()] == [path(2)]


def test_rollout_files_are_taken_as_a_table(spark, tmp_path):
    """A deferred log is opened again with its parent, once that turns up; a parent that is known is opened, not emitted."""
    folder = tmp_path / "sessions"
    folder.mkdir()
    opened = []

    def put(n, lines):
        (folder / path(n).rsplit("/", 1)[1]).write_text("\n".join(lines) + "\n")

    def read(session, files):
        opened.append(sorted(r.file_name[-42:-6].lower() for r in files.collect()))
        return L.read_files(session, files)

    def run(cursors, pending):
        files = L.list_files(spark, str(folder))
        rows_, changes, left = (staged(t, "pass") for t in Y.sync_rollout_files(spark, files, cursors, pending, read, NOW, by_table=True))
        return sorted(r.request_id.rsplit("v1:", 1)[1] for r in rows_.collect()), staged(upsert(cursors, changes, ["file_path"]), "cursors"), left

    cursors, pending = spark.createDataFrame([], CURSOR_SCHEMA), spark.createDataFrame([], Y.PENDING)
    put(2, [meta(2, 30, forked_from_id=uid(1)), token((10, 0, 0), second=31), token((50, 0, 0), second=40)])
    put(3, [meta(3), token((1, 0, 0), second=1)])
    ids, cursors, pending = run(cursors, pending)
    assert ids == [f"{uid(3)}:1"] and [r.pending for r in pending.collect()] == ["missing_parent"]
    put(1, [meta(1), token((10, 0, 0), second=1), token((20, 0, 0), second=90)])
    ids, cursors, pending = run(cursors, pending)
    assert ids == sorted([f"{uid(1)}:1", f"{uid(1)}:2", f"{uid(2)}:2"]) and pending.isEmpty()
    put(4, [meta(4, 80, forked_from_id=uid(1)), token((10, 0, 0), second=81), token((70, 0, 0), second=85)])
    ids, cursors, pending = run(cursors, pending)
    assert ids == [f"{uid(4)}:2"] and pending.isEmpty()
    assert [len(files) for files in opened] == [2, 2, 1, 1]
    assert Y.sync_rollout_files(spark, L.list_files(spark, str(folder)), cursors, pending, read, NOW, by_table=True) is None
