"""Scans and sinks: bars and quotes from tables in any format Spark reads, and raw quotes as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


def read_bars(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schema.BARS).load(path)


def read_quotes(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(schema.QUOTES).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", by: list[str] | None = None) -> None:
    """Writes df, partitioned by columns such as symbol so that later scans prune."""
    writer = df.write.format(format)
    (writer.partitionBy(*by) if by else writer).save(path)


def to_json(df: DataFrame, column: str = "body") -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


QUOTE_DEFAULTS = {"price": 0.0, "previous_close": 0.0, "change": 0.0, "change_percent": 0.0, "day_high": 0.0, "day_low": 0.0, "volume": 0.0, "market_state": "CLOSED"}
PRICES = ("open", "high", "low", "close", "volume")


def fill_quotes(quotes: DataFrame) -> DataFrame:
    """Nulls become defaults; a missing name becomes the symbol."""
    filled = quotes.fillna({k: v for k, v in QUOTE_DEFAULTS.items() if k in quotes.columns})
    return filled.withColumn("short_name", F.coalesce("short_name", "symbol")) if "short_name" in quotes.columns else filled


def fill_bars(bars: DataFrame) -> DataFrame:
    """Missing prices and volumes become 0. Leave it out to keep nulls, which returns and averages then skip."""
    return bars.fillna(0.0, [c for c in PRICES if c in bars.columns])


def point(quotes: DataFrame, symbol: str) -> DataFrame:
    """The latest quote of one symbol."""
    return latest(quotes.where(F.col("symbol") == symbol))


def batch(quotes: DataFrame, symbols: list[str]) -> DataFrame:
    """The latest quote of each symbol asked for, in the order asked; symbols without one are left out."""
    if not symbols:
        raise ValueError("no symbols")
    wanted = quotes.sparkSession.createDataFrame(list(enumerate(symbols)), "ordinal int, symbol string")
    found = latest(quotes.where(F.col("symbol").isin(symbols)))
    return found.join(F.broadcast(wanted), "symbol").orderBy("ordinal")


def latest(quotes: DataFrame) -> DataFrame:
    """The last row of each symbol by ts."""
    rest = [c for c in quotes.columns if c != "symbol"]
    return quotes.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.col("ts")).alias("_q")).select("symbol", *(F.col(f"_q.{c}").alias(c) for c in rest)).select(quotes.columns)


def parse_symbols(text: Column) -> Column:
    """A comma list as an array, empty parts dropped, nothing trimmed."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def symbols_of(text: str) -> list[str]:
    """As parse_symbols, for a parameter; raises ValueError if nothing is left."""
    found = [s for s in (text or "").split(",") if s]
    if not found:
        raise ValueError("symbols are required")
    return found


def text_number(c: Column) -> Column:
    """Numbers as text, maybe with a percent sign; null where it isn't one."""
    return F.regexp_replace(c, "%", "").try_cast("double")


def parse_global_quote(body: Column) -> Column:
    """A quote (symbol, price, change, change_percent) from a provider's JSON, where all numbers are text; null without one."""
    raw = F.from_json(body, "`Global Quote` map<string,string>")["Global Quote"]
    number = lambda key: text_number(F.element_at(raw, F.lit(key)))
    return F.when(
        raw.isNotNull(),
        F.struct(F.element_at(raw, F.lit("01. symbol")).alias("symbol"), number("05. price").alias("price"), number("09. change").alias("change"), number("10. change percent").alias("change_percent")),
    )
