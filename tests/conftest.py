import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallywork.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one column expression over a list of texts."""

    def run(rows, schema, column):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"__i int, {schema}")
        return [r[1] for r in sorted(df.select("__i", column.alias("v")).collect())]

    return run
