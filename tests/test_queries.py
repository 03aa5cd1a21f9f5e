"""Every named query with SQL gives what DuckDB gives for that SQL on the smallest driver tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from weftline.plans import catalog, inputs

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[0] == "k"


@pytest.fixture(scope="module")
def recurring(spark, tmp_path_factory):
    """A folder with orders of which most come again under keys that others have."""
    folder = tmp_path_factory.mktemp("recurring")
    rows = [(k, "O", float(k % 7), "5-LOW") for k in (*range(29, 300, 29), 170, *range(1000029, 1000250, 29), 1000300)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["diff_rows_by_key", "diff_rows_by_key_truncated", "diff_summary", "diff_summary_text"])
def test_recurring_keys_equal_sql(spark, recurring, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{recurring}/orders.parquet/*.parquet'")
    assert normal(catalog.QUERIES[name](spark, recurring).toPandas()) == normal(con.sql(catalog.ORACLE_SQL[name]).df())


def test_rows_of_one_key_stand_in_the_order_of_the_parts_of_the_sql(spark, recurring):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{recurring}/orders.parquet/*.parquet'")
    first, again = inputs.NEW_ORDERS.split("UNION ALL")
    parts = f"SELECT *, 0 AS part FROM ({first}) UNION ALL SELECT *, 1 FROM ({again})"
    placed = con.execute(f"SELECT k, p FROM ({parts}) ORDER BY k, part").fetchall()
    ours = catalog.QUERIES["diff_rows_positional"](spark, recurring).where("new_k IS NOT NULL").collect()
    assert len(ours) > 15
    assert [(r["new_k"], r["new_p"]) for r in ours] == [placed[r["position"]] for r in ours]
