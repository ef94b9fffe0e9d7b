import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "n_words string, fp string, score string, row string, list string, kept string, __row string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        names = extra.split(", ") if extra else []
        return spark.createDataFrame([r + ("x",) * len(names) for r in full], ", ".join([DOCUMENTS, *names]))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very short, very long, repeated and tied rows."""
    prose = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest at night"
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, prose),
        (5, prose),
        (6, prose),
        (None, prose),
        (None, None),
        (7, "é ü 漢字 \U0001f600 …"),
        (8, "x" * 300_000),
        (9, "many words here " * 20_000),
        (10, "123 456 !!! ###"),
    ]


@pytest.fixture(scope="session")
def odd_docs(make_docs, odd_rows):
    """The odd rows, a null in every other column and extra columns with clashing names."""
    docs = make_docs([(d, t, None) for d, t in odd_rows], CLASHES)
    return docs.repartition(3)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make
