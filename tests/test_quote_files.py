"""The data source of quotes: what it reads, skips and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickforge.sources import quote_files

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(s, T0 + dt.timedelta(hours=7 * i, microseconds=i), None if i == 3 else float(i), 1.0) for s in ("a", "b=1/x", "c") for i in range(20)]
    df = spark.createDataFrame(rows, quote_files.SCHEMA)
    quote_files.write(df, str(tmp_path / "q"))
    return df, tmp_path / "q"


def rows(df):
    return sorted((r.symbol, r.ts, r.price, r.volume) for r in df.fillna(-1.0, ["price"]).collect())


def test_round_trip_and_filters(spark, stored):
    df, at = stored
    assert rows(quote_files.read(spark, str(at))) == rows(df)
    assert rows(quote_files.read(spark, f"file://{at}")) == rows(df)
    day = dt.datetime(2024, 1, 3)
    for condition in (F.col("symbol") == "b=1/x", F.col("symbol").isin("a", "c") & (F.col("price") > 4), (F.col("ts") > day) & (F.col("ts") <= day + dt.timedelta(hours=20)), F.col("ts") == T0 + dt.timedelta(hours=14, microseconds=2), (F.col("ts") < day) & (F.col("symbol") == "c"), (F.col("symbol") == "a") | (F.col("ts") > day), (F.col("symbol") == "a") & (F.col("symbol") == "c")):
        assert rows(quote_files.read(spark, str(at)).where(condition)) == rows(df.where(condition)), condition


def parts(df):
    return df.rdd.getNumPartitions()


def test_pushed_filters_skip_files(spark, stored):
    """A file is a partition, and those left out aren't even opened: a broken one among them isn't noticed."""
    df, at = stored
    files = len(list(at.glob("symbol=*/day=*/part-*")))
    read = quote_files.read(spark, str(at))
    assert parts(read) == files == 18
    one_day = read.where((F.col("symbol") == "a") & (F.col("ts") >= dt.datetime(2024, 1, 3)) & (F.col("ts") < dt.datetime(2024, 1, 4)))
    assert parts(one_day) == 1 and one_day.count() > 1
    assert parts(read.where(F.col("symbol").isin("a", "c"))) == 12 and parts(read.where(F.col("ts") >= dt.datetime(2024, 1, 5))) == 6
    reader = quote_files.Reader(str(at), False)
    left = list(reader.pushFilters([quote_files.EqualTo(("symbol",), "a"), quote_files.GreaterThan(("price",), 1.0)]))
    assert len(left) == 1 and len(reader.partitions()) == 6 and reader.symbols == {"a"}


def test_broken_files_are_left_out_and_reported(spark, stored):
    df, at = stored
    bad = sorted(at.glob("symbol=a/day=2024-01-0[23]/part-*"))
    bad[0].write_text('{"ts": "2024-01-02T00:00:00", "price": 1}\n{broken')
    bad[1].write_bytes(b"\xff\xfe")
    strange = at / "symbol=c" / "day=2024-01-04" / "other.json"
    strange.write_text('{"price": 3}\n')
    (at / "symbol=c" / "day=2024-01-04" / "_ignored").write_text("?")
    kept = df.where(~((F.col("symbol") == "a") & F.to_date("ts").isin(dt.date(2024, 1, 2), dt.date(2024, 1, 3))))
    assert rows(quote_files.read(spark, str(at))) == rows(kept)
    told = {r.path.rsplit("/", 1)[1]: r.error for r in quote_files.broken(spark, str(at)).collect()}
    assert told.keys() == {bad[0].name, bad[1].name, "other.json"} and told["other.json"].startswith("KeyError")


def test_empty_and_errors(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert quote_files.read(spark, str(tmp_path / "none")).count() == 0
    quote_files.register(spark)
    with pytest.raises(Exception, match="path"):
        spark.read.format(quote_files.NAME).load().count()
