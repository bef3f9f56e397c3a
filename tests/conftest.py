import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    """Values of either engine in one form."""
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__.startswith("bool"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return repr(float(v))
    return str(v)


def rows_of(frame):
    """Sorted rows, columns by name."""
    cols = sorted(frame.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in frame[cols].astype(object).values.tolist())
