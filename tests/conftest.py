import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rowassay.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def column(spark):
    """Evaluate an expression over a list of texts."""

    def run(values, build, schema="i int, v string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), schema).repartition(2)
        got = rows.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in got]

    return run
