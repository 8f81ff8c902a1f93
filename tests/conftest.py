import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def compare(found, expected) -> None:
    """Rows and column names agree, in any order; floats to nine digits."""

    def shown(v):
        import pandas as pd

        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            # whole numbers come as floats where a column has nulls
            return str(int(v)) if v.is_integer() and abs(v) < 1 << 53 else f"{v:.9g}"
        return str(v)

    def rows(df):
        df = df[sorted(df.columns)]
        return sorted(tuple(shown(v) for v in r) for r in df.itertuples(index=False, name=None))

    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
