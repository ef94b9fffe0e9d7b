"""The stages against plain versions, on the smallest driver tables and on odd rows."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tokentide.llm import decontamination, quality_classifier, quality_rules, simhash
from tokentide.llm.common import table
from tokentide.llm.queries import ORACLES, QUERIES

from .conftest import SF
from .test_decontamination import plain as plain_hits
from .test_packing import check as check_pieces
from .test_simhash import plain_fingerprint, plain_roots


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_dedup", "decontamination", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")) == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES) and "pipeline" in QUERIES and corpus_pipeline.ORACLE_SQL is None


def test_stages_equal_plain_versions(spark):
    docs, labels, benchmark = (table(spark, SF, t) for t in ("documents", "labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    first = corpus_pipeline.staged(stages["quality_classifier"](spark, docs, SF), "t")
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    assert ids(first) == ids(quality_classifier.classify(docs, labels).where("predicted = 1"))

    second = corpus_pipeline.staged(stages["quality_rules"](spark, first, SF), "t")
    assert ids(second) == ids(quality_rules.judge(first, quality_rules.fit(first, labels)).where("kept"))
    good = first.join(labels.where("quality = 1"), "doc_id").join(quality_rules.judge(first, quality_rules.fit(first, labels)).where(~F.col("base_failed")), "doc_id")
    assert good.count() == good.join(second, "doc_id", "left_semi").count()

    third = corpus_pipeline.staged(stages["simhash_dedup"](spark, second, SF), "t")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in second.collect()}
    roots = plain_roots(list(prints.values()))
    assert ids(third) == sorted({roots[p]: min(d for d, q in prints.items() if roots[q] == roots[p]) for p in prints.values()}.values())

    fourth = corpus_pipeline.staged(stages["decontamination"](spark, third, SF), "t")
    rows = third.collect()
    items = [(str(r.item_id), decontamination.words_of(r.text.encode())) for r in benchmark.collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for _, w in items for i in range(max(1, len(w) - 9)) if w}
    clean = []
    for r in rows:
        words = decontamination.words_of(r.text.encode())
        if not any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1)):
            clean.append(r.doc_id)
    assert ids(fourth) == sorted(clean) and fourth.columns == docs.columns

    last = corpus_pipeline.packing.pack(fourth, public_tokenizers.path("byte_bpe_50k.json")).collect()
    from tokenizers import Tokenizer

    check_pieces(last, [(r.doc_id, r.text) for r in fourth.collect()], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    packed = stages["packing"](spark, fourth, SF)
    assert {r.doc_id for r in packed.collect()} == set(clean) and "ids_crc32" in packed.columns
    assert plain_hits and simhash


def test_packed_sequences_hold_their_ids(spark, make_docs):
    from tokenizers import Tokenizer

    texts = {1: "some words to pack " * 700, 2: "short"}
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, make_docs(list(texts.items())), SF)
    pieces = [r for r in corpus_pipeline.staged(packed, "ids").collect()]
    check_pieces(pieces, list(texts.items()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert all(len(r.ids) == 4 * r.length for r in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            made = corpus_pipeline.staged(stage(spark, docs, SF), "odd")
            assert made.count() <= docs.count() or name == "packing"
            if name != "packing":
                assert made.schema == docs.schema
