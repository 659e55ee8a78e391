import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from goldweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of one text column after an expression."""
    def run(values, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]
    return run
