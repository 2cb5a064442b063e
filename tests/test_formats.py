"""Formats of values that the warehouse tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tickforge.functions import scalar
from tickforge.plans import catalog

from .util import assert_same

INF = float("inf")
ODD = {
    "missing": [None],
    "not finite": [float("nan"), INF, -INF],
    "near 0": [-0.0, -0.001, -0.04, 0.05, 0.049999999999999996, 1e-5],
    "halves in decimals": [1.005, -1.005, 2.675, 9.995, 4301.315, -4301.315, 11511.115, 0.35, 8.35, 1250.0, -1350.0],
    "halves in binary": [0.125, 0.375, -0.125, 123456789.125, 0.25, 0.75],
    "next unit": [999.949, 999.95, 999.96, -999.96, 999949.99, 999950.0, 999999.99],
    "large": [1e9, -1e9, 1.5e9, 2.25e12, 1e15, 9007199254740993.0, 72057594037927952.0, -1e16],
}


@pytest.mark.parametrize("kind", ODD)
def test_odd_numbers_equal_sql(spark, tmp_path, kind):
    spark.createDataFrame(list(enumerate(ODD[kind])), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert_same(catalog.queries()["format_numbers"](spark, str(tmp_path)), con, catalog.oracle_sql()["format_numbers"])


def test_units(spark):
    rows = spark.createDataFrame([(999.0,), (4.5e9,), (-6e12,)], "v double")
    got = rows.select(scalar.number(F.col("v")).alias("a"), scalar.number(F.col("v"), "M").alias("b"), scalar.percent(F.col("v"), 0).alias("p")).collect()
    assert [tuple(r) for r in got] == [("999", "999", "+999%"), ("4.5B", "4500M", "+4500000000%"), ("-6T", "-6000000M", "-6000000000000%")]
