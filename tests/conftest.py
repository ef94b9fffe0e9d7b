import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tokentide.schema import USAGE_SCHEMA, conform  # noqa: E402
from tokentide.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


_TYPES = {f.name: f.dataType.simpleString() for f in USAGE_SCHEMA}


@pytest.fixture(scope="session")
def make_usage(spark):
    """Usage rows from dicts; absent columns take their default."""

    def make(rows):
        base = {
            "provider_id": "_session",
            "app_type": "claude",
            "model": "m",
            "created_at": 1_700_000_000,
            "data_source": "session_log",
        }
        full = [{"request_id": f"r{i}", **base, **r} for i, r in enumerate(rows)]
        names = sorted({k for r in full for k in r})
        schema = ", ".join(f"{n} {'string' if _TYPES[n].startswith('decimal') else _TYPES[n]}" for n in names)
        return conform(spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema))

    return make


@pytest.fixture(scope="session")
def make_lines(spark):
    def make(logs):
        """Lines of logs given as path -> texts."""
        rows = [(p, p.split("/")[-1], i, t) for p, texts in logs.items() for i, t in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "file_path string, file_name string, line_no bigint, value string")

    return make
