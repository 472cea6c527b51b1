import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.local.dir": tmp, "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.sql.session.timeZone": "UTC"}
    s = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def sf01():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def duck():
    """Views over the tables of a folder."""

    def open_at(folder: str):
        con = duckdb.connect()
        for t in TABLES:
            if os.path.exists(f"{folder}/{t}.parquet"):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return open_at


def canonical(pdf):
    """Sorted rows as texts, columns by name, floats to seven digits."""
    import math

    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)

    return sorted("|".join(map(one, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
