import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from limitloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "limitloom-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("a int, b string", (1, "x"), ..)``"""

    def make(schema, *rows):
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def one(spark):
    """Evaluate a column expression on a single row."""

    def evaluate(column, schema=None, row=None):
        df = spark.range(1) if schema is None else spark.createDataFrame([row], schema)
        return df.select(column.alias("v")).first()["v"]

    return evaluate


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listed(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=repr)
