import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hirelode.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over literals, in order."""

    def run(function, *rows, columns=("v",)):
        data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        schema = "i int, " + ", ".join(c if " " in c else f"{c} string" for c in columns)
        df = spark.createDataFrame(data, schema)
        result = df.select("i", function(*[c.split()[0] for c in columns]).alias("r"))
        return [row.r for row in sorted(result.collect(), key=lambda row: row.i)]

    return run


@pytest.fixture
def plan():
    """Text of the physical plan."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
