"""Quotes or bars in files as a Python data source: `spark.read.format("quote_files").option("path", ...)`.

Files are JSON lines in folders `symbol=<name>/day=<yyyy-mm-dd>`, as Spark's own writer lays them out. Each file is a partition. Filters on symbol
and on ts are pushed: they leave out files by their folders, without opening them, and are checked again on rows. A file that can't be read or
parsed is left out, the others are served; with option `report` set to true the same read returns the broken files (path, error) instead of rows.

Paths are opened by pyarrow's file systems (a shared mount, s3, gcs, hdfs), by driver and executors alike; anything else raises.
Set spark.sql.python.filterPushdown.enabled for filters to be pushed.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "quote_files"
SCHEMA = "symbol string, ts timestamp_ntz, price double, volume double"
REPORT = "path string, error string"
_FOLDERS = re.compile(r"/symbol=([^/]+)/day=(\d{4}-\d{2}-\d{2})/[^/_.][^/]*$")
_COMPARE = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


@dataclass
class File(InputPartition):
    path: str
    symbol: str


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, path: str, report: bool):
        self.path, self.report = path, report
        self.symbols: set[str] | None = None
        self.times: list[tuple[type, dt.datetime]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.symbols = asked if self.symbols is None else self.symbols & asked
            elif type(f) in _COMPARE and f.attribute == ("ts",) and isinstance(f.value, dt.datetime):
                self.times.append((type(f), f.value.replace(tzinfo=None)))
            else:
                yield f

    def _day_may_match(self, day: dt.date) -> bool:
        first, end = dt.datetime.combine(day, dt.time()), dt.datetime.combine(day + dt.timedelta(days=1), dt.time())
        for kind, t in self.times:
            if kind in (GreaterThan, GreaterThanOrEqual, EqualTo) and end <= t:
                return False
            if (kind is LessThan and first >= t) or (kind in (LessThanOrEqual, EqualTo) and first > t):
                return False
        return True

    def partitions(self) -> list[File]:
        fs, at = _opened(self.path)
        found = []
        for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
            if f.type == pafs.FileType.File and (m := _FOLDERS.search(f.path)):
                symbol = unquote(m[1])
                if (self.symbols is None or symbol in self.symbols) and self._day_may_match(dt.date.fromisoformat(m[2])):
                    found.append(File(f.path, symbol))
        return sorted(found, key=lambda f: f.path)

    def _rows(self, file: File) -> pa.RecordBatch:
        fs, _ = _opened(self.path)
        with fs.open_input_file(file.path) as f:
            quotes = [json.loads(line) for line in f.read().decode().splitlines() if line]
        number = lambda v: None if v is None else float(v)
        rows = [(dt.datetime.fromisoformat(q["ts"]).replace(tzinfo=None), number(q.get("price")), number(q.get("volume"))) for q in quotes]
        rows = [r for r in rows if all(_COMPARE[kind](r[0], t) for kind, t in self.times)]
        columns = [pa.array([file.symbol] * len(rows), pa.string())] + [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.timestamp("us"), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["symbol", "ts", "price", "volume"])

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        error = None
        try:
            batch = self._rows(partition)
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
            error = f"{type(e).__name__}: {e}"
        if self.report:
            broken = [partition.path] if error else []
            yield pa.RecordBatch.from_arrays([pa.array(broken, pa.string()), pa.array([error] if error else [], pa.string())], names=["path", "error"])
        elif not error:
            yield batch


class QuoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _report(self) -> bool:
        return str(self.options.get("report", "false")).lower() == "true"

    def schema(self) -> str:
        return REPORT if self._report() else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("option path is required")
        return Reader(self.options["path"], self._report())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets it push filters."""
    spark.dataSource.register(QuoteFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).load()


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that read leaves out. All files are opened."""
    register(spark)
    return spark.read.format(NAME).option("path", path).option("report", "true").load()


def write(quotes: DataFrame, path: str) -> None:
    """Writes quotes (symbol, ts, price, volume) in the layout that read expects."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = quotes.select("symbol", F.to_date("ts").alias("day"), text.alias("ts"), "price", "volume")
    rows.repartition("symbol", "day").write.partitionBy("symbol", "day").json(path)
