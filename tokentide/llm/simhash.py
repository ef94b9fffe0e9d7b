"""SimHash near-duplicates: positional byte index, count filter, components.

Two fingerprints that differ in at most four bits differ in at most four of
their eight bytes, so they share at least four bytes in place: the guaranteed
minimum of matches. The index therefore has one list for each choice of four
byte positions and their four values (70 lists a fingerprint). Every pair that
reaches the minimum meets in a list; its shared positional bytes are tallied,
the pair is kept in the list of its first four shared positions only, and the
differing bits are counted.

Lists of one fingerprint end at the count. In a list of more than
``list_pairs`` members no pairs are made: inside a list at most 32 bits are free,
and two fingerprints are within four bits exactly if some point lies within two
bits of both, so members meet at the 529 points around them, which is linear in
the list.

Defined cases: a null or empty text, or one of white space, has fingerprint
zero, linked like any other; repeated rows share their fingerprint; a null
doc_id is never the smallest of its component unless all are null; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..session import staged
from .common import per_document, texts_of

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Members up to which the pairs of a list are compared one by one.
LIST_PAIRS = 256
#: Lists up to which the table of shared lists is broadcast (16 bytes a list).
BROADCAST_LISTS = 200_000
#: Rows up to which the list of dropped rows is broadcast (8 bytes a row).
BROADCAST_ROWS = 1_000_000
CHOICES = list(combinations(range(BYTES), MIN_SHARED))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash, unsigned: a bit is one if over half of the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long) of every row; one pass, no shuffle."""

    def start():
        def score(batch):
            made = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64)
            return [made.view(np.int64)]

        return score

    return per_document(docs, [StructField("fp", LongType(), False)], start)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _joined_bytes(fp: Column, positions) -> Column:
    parts = [F.shiftleft(_byte(fp, p), 8 * i) for i, p in enumerate(positions)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _rest(fp: Column, choice: Column) -> Column:
    """The 32 bits outside of the chosen positions."""
    rests = [_joined_bytes(fp, [p for p in range(BYTES) if p not in c]) for c in CHOICES]
    return F.array(*rests)[choice]


def _index(prints: DataFrame) -> DataFrame:
    """(list, choice, fp): the 70 lists of each fingerprint; a list is the choice and its four bytes."""
    lists = [F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(_joined_bytes(F.col("fp"), c)) for i, c in enumerate(CHOICES)]
    return prints.select("fp", F.explode(F.array(*lists)).alias("list"))


def _compared(members: DataFrame) -> DataFrame:
    """Linked pairs of short lists: tally the shared positional bytes, keep those with enough, verify."""
    a = members.select("list", F.col("fp").alias("a"))
    b = members.select(F.col("list").alias("other"), F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    shared = [(_byte(differing, p) == 0).cast("int") for p in range(BYTES)]
    tally = reduce(lambda x, y: x + y, shared)
    # a pair stands in every list of four of its shared positions; the first such list keeps it
    first, before = F.lit(0), F.lit(0)
    for p, hit in enumerate(shared):
        first = first + F.when(before < MIN_SHARED, hit * (1 << p)).otherwise(0)
        before = before + hit
    own = F.array(*[F.lit(sum(1 << p for p in c)) for c in CHOICES])[F.shiftright("list", 32).cast("int")]
    linked = (
        (F.col("list") == F.col("other"))
        & (F.col("a") < F.col("b"))
        & (tally >= MIN_SHARED)
        & (F.bit_count(differing) <= MAX_BITS)
        & (first == own)
    )
    return a.join(b, linked).select("a", "b")


def _through_points(members: DataFrame) -> DataFrame:
    """Links of long lists: members around a common point are joined to its smallest member."""
    near = [0] + [1 << i for i in range(32)] + [(1 << i) | (1 << j) for i, j in combinations(range(32), 2)]
    choice = F.shiftright("list", 32).cast("int")
    points = members.withColumn("rest", _rest(F.col("fp"), choice)).select(
        "fp", "list", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: F.col("rest").bitwiseXOR(m.cast("long")))).alias("point")
    )
    hubs = points.groupBy("list", "point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return points.join(hubs, ["list", "point"]).where("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def links(prints: DataFrame, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """Edges (a < b) whose components are those of all pairs within four bits.

    ``prints``: distinct ``fp``, already stored (it is read more than once).
    """
    # stored prints are small files, and each row becomes 70: spread them first
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = _index(prints.repartition(width))
    lists = staged(index.groupBy("list").count().where("count > 1"), "simhash-lists")
    # the lists' number is known: their table is sent to all tasks only while small
    side = F.broadcast(lists) if lists.count() <= BROADCAST_LISTS else lists
    members = staged(index.join(side, "list"), "simhash-members")
    found = _compared(members.where(F.col("count") <= list_pairs))
    if (members.agg(F.max("count")).first()[0] or 0) > list_pairs:
        found = found.unionByName(_through_points(members.where(F.col("count") > list_pairs).select("list", "fp")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every fingerprint that has a link; alternates large-star and small-star.

    Each round ends in a stored table. Joins and minima only, so a fingerprint with
    very many links is split like any skewed join key.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a"))).first())

    current = staged(edges, "simhash-edges")
    now = state(current)
    while now[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        large = staged(large, "simhash-large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a != m").select(F.col("m"), F.col("a").alias("x"))
        small = low.select("m", F.col("b").alias("x")).unionByName(small).select(F.least("m", "x").alias("a"), F.greatest("m", "x").alias("b"))
        current = staged(small.distinct(), "simhash-small")
        before, now = now, state(current)
        if now == before:
            break
    return current.select(F.col("b").alias("fp"), F.col("a").alias("root")).unionByName(current.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())


def roots(prints: DataFrame, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """(fp, root) of the linked fingerprints among the rows of ``prints``."""
    return components(links(staged(prints.select("fp").distinct(), "simhash-prints"), list_pairs))


def near_duplicates(docs: DataFrame, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row of ``docs``.

    component_id is the smallest doc_id of the rows reachable over links.
    """
    prints = staged(fingerprints(docs), "simhash-docs")
    known = roots(prints, list_pairs)
    classes = (
        prints.groupBy("fp")
        .agg(F.min("doc_id").alias("least"))
        .join(known, "fp", "left")
        .withColumn("root", F.coalesce("root", "fp"))
    )
    classes = staged(classes, "simhash-classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = classes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, list_pairs: int = LIST_PAIRS) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each component.

    Among rows with the same smallest doc_id, one stays. Columns are unchanged. Only
    the numbers of dropped rows meet the texts: sent to all tasks while they are few,
    by a shuffle join beyond that.
    """
    columns = docs.columns
    own = "__row"
    while own in columns:
        own += "_"
    stored = staged(docs.withColumn(own, F.monotonically_increasing_id()), "simhash-rows")
    rows = stored.select(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(own).alias("row")).alias("doc_id"), "text")
    prints = staged(fingerprints(rows), "simhash-docs")
    known = roots(prints, list_pairs)
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(known, "fp", "left")
    kept = classes.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.row").alias(own))
    dropped = staged(prints.select(F.col("doc_id.row").alias(own)).join(kept, own, "left_anti"), "simhash-dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return stored.join(dropped, own, "left_anti").select(*columns)
