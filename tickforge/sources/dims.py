"""The fixed dimension tables as DataFrames. Their sizes are fixed, so joins may broadcast them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from . import schema, static_tables as t


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(t.INSTRUMENTS)], schema.INSTRUMENTS)


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(t.SOURCES)], schema.SOURCES)


def regions(spark: SparkSession) -> DataFrame:
    """Regions with their countries and the countries' demand by type, nested."""
    rows = [(r, p, c, [(n, f, q, [(k, v, t.DEMAND_COLORS[k]) for k, v in b.items()]) for n, f, q, b in countries]) for r, p, c, countries in t.REGIONS]
    return spark.createDataFrame(rows, schema.REGIONS)


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, date.fromisoformat(d), title, text) for i, (d, title, text) in enumerate(t.EVENTS)], schema.EVENTS)


def funds(spark: SparkSession) -> DataFrame:
    """The fund universe in order, with display colours."""
    return spark.createDataFrame([(i, s, t.SYMBOL_COLORS.get(s, t.DEFAULT_COLOR)) for i, s in enumerate(t.ALL_FUNDS)], "ordinal int, symbol string, color string")


def demand_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(t.DEMAND_COLORS.items()), "type string, color string")
