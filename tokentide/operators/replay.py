"""Removing history that a forked thread copied from its parent.

A forked log starts with a replay of its parent. The replayed prefix is the
longest run of the child's first events that appears, in order, among the
parent's events up to the fork.

Taking the j-th copy of a signature in the child with the j-th copy in the
parent gives every child event at most one partner, by a plain equality join.
As long as the partners rise in the parent, they are exactly what matching from
the left would take: it can use no earlier copy than the j-th, and this one is
available. The prefix ends for certain where the parent has no j-th copy.

Where a partner falls back behind an earlier one, matching from the left may still
go on with a later copy. Partners are lower bounds then, and are raised: a fallen one
to the next copy after the furthest partner before it, and with it, as copies are used
in order, all later events of that signature by as many copies. A round raises all that
have fallen, anywhere in a child; events beyond the first without a partner are
dropped. What no round changes is the least solution, that of matching from the left.
The copies passed by a partner are counted by putting the children's questions among the
parent's own events, so no child is joined with its parent's timeline.

A parent whose times run backwards has, for each fork, events of its own that lie before
it; only such children get a filtered timeline each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .ordered import CHUNK_ROWS, running, wide_groups


def parent_timeline(records: DataFrame) -> DataFrame:
    """Events a child may have copied: (file_path, thread_id, line_no, ts, signature)."""
    return records.filter("kind = 'token'").select("file_path", "thread_id", "line_no", "ts", "signature")


def parent_files(records: DataFrame) -> DataFrame:
    """Per file: how far it was written, and whether a token event lacks its time."""
    return records.groupBy("file_path", "thread_id").agg(
        F.max("ts").alias("written_to"),
        F.count_if((F.col("kind") == "token") & F.col("ts").isNull()).alias("untimed"),
    )


def _first_difference(timeline: DataFrame, copies: DataFrame, chunk_rows: int) -> DataFrame:
    """Per thread with copies: where they first differ in an event or its time.

    (thread_id, n_copies, at, until, sure, backwards): the earliest and latest time of
    that event, whether the copies differ in more than its time, and whether times run
    backwards in a copy. ``at`` is NULL when the copies are equal.
    """
    placed = running(
        timeline.join(copies, "thread_id").select("thread_id", "n_copies", "file_path", "line_no", "signature", "ts"),
        ["thread_id", "file_path"],
        "line_no",
        count={"_pos": F.lit(True)},
        last_before={"_t": F.col("ts")},
        chunk_rows=chunk_rows,
    )
    place = placed.groupBy("thread_id", "n_copies", "_pos").agg(
        ((F.count("*") != F.first("n_copies")) | (F.min("signature") != F.max("signature"))).alias("_sure"),
        F.min("ts").alias("_lo"),
        F.max("ts").alias("_hi"),
        F.max(F.coalesce(F.col("ts") < F.col("_t"), F.lit(False))).alias("_back"),
    )
    differs = F.col("_sure") | (F.col("_lo") != F.col("_hi"))
    first = F.min_by(F.struct("_lo", "_hi", "_sure"), F.when(differs, F.col("_pos")))
    return (
        place.groupBy("thread_id", "n_copies")
        .agg(first.alias("_d"), F.max("_back").alias("backwards"))
        .select("thread_id", "n_copies", F.col("_d._lo").alias("at"), F.col("_d._hi").alias("until"), F.col("_d._sure").alias("sure"), "backwards")
    )


def _conflicting(children: DataFrame, timeline: DataFrame, files: DataFrame, chunk_rows: int) -> DataFrame:
    """Children whose parent exists in several copies that differ up to the fork.

    Copies are compared once per parent. While times do not run backwards, a fork
    before the first difference sees equal copies, and one after an event that is
    missing or another in a copy sees unequal ones. Only forks between, where copies
    give one event several times, are compared position by position for the child.
    """
    copies = files.groupBy("thread_id").agg(F.count("*").alias("n_copies")).filter("n_copies > 1")
    asked = children.select(F.col("file_path").alias("child"), F.col("parent_id").alias("thread_id"), "fork_ts")
    told = staged(asked.join(_first_difference(timeline, copies, chunk_rows), "thread_id"), "copies")
    orderly = ~F.col("backwards")
    differs = orderly & F.col("sure") & (F.col("fork_ts") >= F.col("until"))
    equal = orderly & (F.col("at").isNull() | (F.col("fork_ts") < F.col("at")))
    unsure = told.filter(~F.coalesce(differs | equal, F.lit(False))).select("child", "thread_id", "fork_ts", "n_copies")
    return told.filter(differs).select("child").unionByName(_compared(unsure, timeline, chunk_rows)).distinct()


def _compared(asked: DataFrame, timeline: DataFrame, chunk_rows: int) -> DataFrame:
    """Children (with thread_id, fork_ts, n_copies) whose parent's copies differ up to the fork, by position."""
    seen = timeline.join(asked, "thread_id").filter(F.col("ts") <= F.col("fork_ts"))
    placed = running(
        seen.select("child", "n_copies", "file_path", "line_no", "signature"),
        ["child", "file_path"],
        "line_no",
        count={"_pos": F.lit(True)},
        chunk_rows=chunk_rows,
    )
    same = placed.groupBy("child", "_pos").agg(
        F.count("*").alias("_n"),
        F.first("n_copies").alias("_all"),
        F.min("signature").alias("_a"),
        F.max("signature").alias("_b"),
    )
    return same.filter((F.col("_n") != F.col("_all")) | (F.col("_a") != F.col("_b"))).select("child").distinct()


def resolve_parents(threads: DataFrame, records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Threads with ``pending`` (NULL, stable, missing_parent or retryable) and its reason.

    A parent can be used when a log of it exists, every copy was written up to
    the fork, none of its events lacks a time and all copies agree.
    """
    files = parent_files(records)
    state = files.groupBy("thread_id").agg(
        F.min(F.coalesce(F.col("written_to"), F.lit(0).cast("timestamp"))).alias("_written"),
        F.sum("untimed").alias("_untimed"),
        F.min("file_path").alias("parent_path"),
    )
    wanted = threads.filter((F.col("parent_status") == "parent") & F.col("fork_ts").isNotNull())
    conflicts = _conflicting(wanted, parent_timeline(records), files, chunk_rows).select(
        F.col("child").alias("file_path"), F.lit(True).alias("_conflict")
    )
    out = threads.join(state.withColumnRenamed("thread_id", "parent_id"), "parent_id", "left").join(
        conflicts, "file_path", "left"
    )
    is_child = F.col("parent_status") == "parent"
    stable = (
        F.when(F.col("thread_id").isNull(), "file name has no thread id")
        .when(F.col("parent_status").isNull(), "no meta record")
        .when(F.col("parent_status") == "deferred", F.col("reason"))
        .when(is_child & F.col("fork_ts").isNull(), "meta record has no time")
    )
    retry = F.when(
        is_child,
        F.when(F.col("_untimed") > 0, "parent event has no time")
        .when(F.col("_written") < F.col("fork_ts"), "parent not written up to the fork")
        .when(F.col("_conflict"), "copies of the parent differ"),
    )
    missing = F.when(is_child & F.col("parent_path").isNull(), F.concat(F.lit("no log of "), F.col("parent_id")))
    return out.select(
        "file_path",
        "thread_id",
        "fork_ts",
        "parent_status",
        "parent_id",
        "parent_path",
        F.when(stable.isNotNull(), "stable")
        .when(missing.isNotNull(), "missing_parent")
        .when(retry.isNotNull(), "retryable")
        .alias("pending"),
        F.coalesce(stable, missing, retry).alias("pending_reason"),
    )


def _ranked(df: DataFrame, keys: list[str], order: str, chunk_rows: int, wide: DataFrame) -> DataFrame:
    """Number the copies of each signature."""
    return running(df, [*keys, "signature"], order, count={"copy_no": F.lit(True)}, chunk_rows=chunk_rows, wide=wide)


def _first_stop(paired: DataFrame, chunk_rows: int, wide: DataFrame) -> DataFrame:
    """Per child: the first position that does not continue the run, whether it has fallen only, and the last position."""
    linked = running(paired, ["child"], "position", last_before={"_before": F.col("place")}, chunk_rows=chunk_rows, wide=wide)
    falls = F.col("place") <= F.col("_before")
    broken = F.col("place").isNull() | F.coalesce(falls, F.lit(False))
    stop = F.min_by(F.struct("position", F.col("place").isNotNull().alias("fallen")), F.when(broken, F.col("position")))
    absent = F.min(F.when(F.col("place").isNull(), F.col("position"))).alias("absent")
    return linked.groupBy("child").agg(stop.alias("stop"), absent, F.max("position").alias("end"))


def _copies_passed(fallen: DataFrame, numbered: DataFrame, chunk_rows: int) -> DataFrame:
    """Of fallen events (child, position, source, signature, _peak): how many copies of the signature lie up to _peak.

    The questions stand among the source's events of the same signature, in order of place.
    """
    own = numbered.join(fallen.select("source", "signature").distinct(), ["source", "signature"], "left_semi")
    # a question comes after the copy at its own place
    events = own.select("source", "signature", (2 * F.col("place")).alias("_at"), "copy_no", F.lit(None).cast("array<struct<child:string,position:bigint>>").alias("_asked"))
    asked = fallen.groupBy("source", "signature", (2 * F.col("_peak") + 1).alias("_at")).agg(
        F.collect_list(F.struct("child", F.col("position").cast("bigint").alias("position"))).alias("_asked")
    )
    mixed = events.unionByName(asked, allowMissingColumns=True)
    passed = running(mixed, ["source", "signature"], "_at", last={"_passed": F.col("copy_no")}, chunk_rows=2 * chunk_rows)
    return passed.filter("_asked is not null").select(F.inline("_asked"), F.coalesce("_passed", F.lit(0)).alias("_passed"))


def _raised(state: DataFrame, numbered: DataFrame, chunk_rows: int, wide: DataFrame) -> tuple[DataFrame, bool]:
    """One round over (child, position, source, signature, copy_no, rank, place); whether anything had fallen."""
    peaks = staged(running(state, ["child"], "position", peak_before={"_peak": F.col("place")}, chunk_rows=chunk_rows, wide=wide), "replay-peaks")
    fallen = peaks.filter(F.col("place") <= F.col("_peak"))
    if fallen.isEmpty():
        return state, False
    passed = _copies_passed(fallen, numbered, chunk_rows)
    least = peaks.join(passed, ["child", "position"], "left").withColumn("_least", F.greatest(F.col("rank"), F.col("_passed") + 1))
    # copies are used in order, so what one event skips all later ones of its signature skip too
    skipped = running(least, ["child", "signature"], "position", peak={"_skip": F.col("_least") - F.col("copy_no")}, chunk_rows=chunk_rows, wide=wide)
    ranked = skipped.select("child", "position", "source", "signature", "copy_no", (F.col("copy_no") + F.col("_skip")).alias("rank"))
    found = numbered.select("source", "signature", F.col("copy_no").alias("rank"), "place")
    placed = staged(ranked.join(found, ["source", "signature", "rank"], "left"), "replay-placed")
    absent = placed.filter("place is null").groupBy("child").agg(F.min("position").alias("_absent"))
    kept = placed.join(absent, "child", "left").filter(F.coalesce(F.col("position") < F.col("_absent"), F.lit(True))).drop("_absent")
    return staged(kept, "replay-state"), True


def replay_prefix(
    threads: DataFrame, events: DataFrame, timeline: DataFrame, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(file_path, replay_prefix) of children whose parent is usable.

    ``threads`` comes from resolve_parents, ``events`` from token_events,
    ``timeline`` from parent_timeline.
    """
    usable = threads.filter((F.col("parent_status") == "parent") & F.col("pending").isNull())
    links = usable.select(F.col("file_path").alias("child"), "parent_path", "fork_ts")
    parents = links.select("parent_path").distinct()
    source = timeline.join(parents, timeline["file_path"] == parents["parent_path"], "left_semi").select(
        F.col("file_path").alias("parent_path"), F.col("line_no").alias("place"), "ts", "signature"
    )
    # logs that reach over several ranges of lines, and children that do of positions
    long_logs = wide_groups(timeline, "file_path", "line_no", chunk_rows)
    long_children = wide_groups(events, "file_path", "position", chunk_rows)
    times = running(source, ["parent_path"], "place", last_before={"_t": F.col("ts")}, chunk_rows=chunk_rows, wide=long_logs)
    backwards = staged(times.filter(F.col("ts") < F.col("_t")).select("parent_path").distinct(), "replay-backwards")

    # what a child is matched with: its parent's events, or those before its own fork
    odd = links.join(backwards, "parent_path", "left_semi")
    own = odd.join(source, "parent_path").filter(F.col("ts") <= F.col("fork_ts")).select(F.col("child").alias("source"), "place", "ts", "signature")
    shared = source.withColumnRenamed("parent_path", "source").select("source", "place", "ts", "signature")
    # the events before a fork are in the child's name
    long_own = odd.join(long_logs.withColumnRenamed("file_path", "parent_path"), "parent_path", "left_semi").select("child")
    long_sources = staged(long_logs.union(long_own), "wide-groups")
    numbered = staged(_ranked(shared.unionByName(own), ["source"], "place", chunk_rows, long_sources), "replay-numbered")
    asked = links.join(backwards.withColumn("_back", F.lit(True)), "parent_path", "left").select(
        "child", "fork_ts", F.when(F.col("_back"), F.col("child")).otherwise(F.col("parent_path")).alias("source")
    )
    child = events.join(asked.withColumnRenamed("child", "file_path"), "file_path").select(
        F.col("file_path").alias("child"), "source", "fork_ts", "position", "signature"
    )
    paired = staged(
        _ranked(child, ["child"], "position", chunk_rows, long_children)
        .join(numbered, ["source", "signature", "copy_no"], "left")
        # in order of time what follows an event after the fork is after it too
        .withColumn("place", F.when(F.col("ts") <= F.col("fork_ts"), F.col("place")))
        .select("child", "source", "fork_ts", "position", "signature", "copy_no", "place"),
        "replay-paired",
    )
    stops = staged(_first_stop(paired, chunk_rows, long_children), "replay-stops")
    settled = stops.filter(~F.coalesce(F.col("stop.fallen"), F.lit(False))).select(
        F.col("child").alias("file_path"), F.coalesce(F.col("stop.position") - 1, F.col("end")).alias("replay_prefix")
    )
    open_ = stops.filter("stop.fallen").select("child", "absent")
    if open_.isEmpty():
        return settled

    state = paired.join(open_, "child").filter(F.coalesce(F.col("position") < F.col("absent"), F.lit(True)))
    forks = state.select("child", "source", "fork_ts").distinct()
    before_fork = numbered.join(forks.select("source").distinct(), "source", "left_semi")
    state = staged(state.select("child", "position", "source", "signature", "copy_no", F.col("copy_no").alias("rank"), "place"), "replay-state")
    going = True
    while going:
        state, going = _raised(state, before_fork, chunk_rows, long_children)
        if going:
            # a copy after the fork is no partner, nor is what comes after its event in the child
            late = (
                state.join(forks.select("child", "fork_ts"), "child")
                .join(before_fork.select("source", "place", "ts"), ["source", "place"])
                .filter(F.col("ts") > F.col("fork_ts"))
                .groupBy("child")
                .agg(F.min("position").alias("_late"))
            )
            state = staged(state.join(late, "child", "left").filter(F.coalesce(F.col("position") < F.col("_late"), F.lit(True))).drop("_late"), "replay-state")
    counted = open_.select(F.col("child").alias("file_path")).join(
        state.groupBy(F.col("child").alias("file_path")).agg(F.max("position").alias("_end")), "file_path", "left"
    )
    return settled.unionByName(counted.select("file_path", F.coalesce("_end", F.lit(0)).cast(settled.schema["replay_prefix"].dataType).alias("replay_prefix")))


def drop_replayed(events: DataFrame, threads: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Events of usable threads beyond their replayed prefix; numbering is kept."""
    ready = threads.filter("pending is null").select("file_path")
    return (
        events.join(ready, "file_path", "left_semi")
        .join(prefixes, "file_path", "left")
        .filter(F.col("position") > F.coalesce("replay_prefix", F.lit(0)))
        .drop("replay_prefix")
    )
