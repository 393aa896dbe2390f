"""Every registered plan with SQL gives the rows of its SQL at the smallest scale."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from lodestone.plans import derived, measured  # noqa: F401  they register their queries
from lodestone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(f"{v:.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0
        return
    got, want = got.toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_an_order_without_a_baseline_is_an_error(spark, tmp_path):
    n = QUERIES["joi3_all_baselines"](spark, SF).agg({"n": "sum"}).first()[0]
    assert n == spark.read.parquet(f"{SF}/orders.parquet").count()
    spark.createDataFrame([("1-URGENT", 1.0), ("6-NEW", 2.0)], "o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    with pytest.raises(Exception, match="no random baseline for 6-NEW"):
        QUERIES["joi3_all_baselines"](spark, str(tmp_path)).collect()


def test_entry_needs_no_session_to_import():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
