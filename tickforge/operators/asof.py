"""As-of joins: each row with the row of another table that is nearest in time, before it or after it, at any reach and resolution.

Both tables are put in one order by key and time and cut into slices of rows. Within a slice the last known row of the other table is carried
forwards and the next one backwards; what lies in other slices comes from one row a slice, carried over slices. So a key with a third of
all rows is many tasks, and the work doesn't depend on how far apart rows are. All of it is windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indicators

NEAREST, BEFORE, AFTER = "nearest", "before", "after"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def join_asof(
    left: DataFrame, right: DataFrame, by: list[str], ts: str = "ts", ordinal: str = "ordinal", direction: str = NEAREST, reach_seconds: float | None = None,
    rows: int = indicators.SLICE_ROWS, bucket: str = "day", out: str = "match",
) -> DataFrame:
    """left and `out`, a struct of right's columns other than `by`, or null: the row of the same key with the nearest time (both sides count, a row of the same moment too).

    Of right's rows of one moment, and of two that are equally near, that with the smaller `ordinal` (a column of right) is taken. Further away than
    `reach_seconds` is no match. Rows of left without a key or time have none; such rows of right are left out. Numbers of rows are counted by `bucket`
    first, so no task sees more than a key's buckets or a bucket's rows.
    """
    if direction not in (NEAREST, BEFORE, AFTER):
        raise ValueError(f"unknown direction {direction}")
    keys = [f"_k{i}" for i in range(len(by))]
    has_key = lambda c: F.lit(True) if not c else F.col(c[0]).isNotNull() & has_key(c[1:])
    payload = [c for c in right.columns if c not in by]
    kinds = dict(right.dtypes)
    theirs = "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in payload) + ">"
    found = right.where(has_key([*by, ts])).groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(ts).alias("_ts")).agg(F.min_by(F.struct(*payload), ordinal).alias("_r"))
    whole = F.struct(*(F.col(c) for c in left.columns))
    asked = left.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(ts).alias("_ts"), whole.alias("_l"))
    both = asked.where(has_key([*keys, "_ts"])).withColumns({"_r": F.lit(None).cast(theirs), "_side": F.lit(1)}).unionByName(found.withColumns({"_l": F.lit(None).cast(dict(asked.dtypes)["_l"]), "_side": F.lit(0)}))
    numbered = indicators.positions(both, "_ts", tuple(keys), bucket, "_side")
    cut = numbered.withColumn("slice", F.floor((F.col("rn") - 1) / rows))
    at, series = F.struct("rn", "_r"), Window.partitionBy(*keys).orderBy("slice")
    known = F.when(F.col("_r").isNotNull(), at)
    ends = cut.groupBy(*keys, "slice").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("rn"))).alias("_last"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("rn"))).alias("_first"))
    earlier = F.last("_last", ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("_first", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, "slice", earlier.alias("_earlier"), later.alias("_later"))
    slices = Window.partitionBy(*keys, "slice")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    near = cut.join(carried, [*keys, "slice"]).withColumns({
        "_before": F.coalesce(F.last(known, ignorenulls=True).over(slices.orderBy("rn").rowsBetween(*so_far))["_r"], "_earlier"),
        "_after": F.coalesce(F.last(known, ignorenulls=True).over(slices.orderBy(F.desc("rn")).rowsBetween(*so_far))["_r"], "_later"),
    })
    mine = near.where("_side = 1")
    here, back, on = _micros(F.col("_ts")), _micros(F.col(f"_before.{ts}")), _micros(F.col(f"_after.{ts}"))
    gap_back, gap_on = here - back, on - here
    tied = F.col(f"_after.{ordinal}") < F.col(f"_before.{ordinal}")
    forwards = F.col("_before").isNull() | (gap_on < gap_back) | ((gap_on == gap_back) & tied)
    # A row of the same moment is the one before; it is the one after just as well.
    same = gap_back == 0
    picks = {NEAREST: F.when(F.coalesce(forwards, F.lit(False)), F.col("_after")).otherwise(F.col("_before")), BEFORE: F.col("_before"), AFTER: F.when(same, F.col("_before")).otherwise(F.col("_after"))}
    mine = mine.withColumn(out, picks[direction])
    if reach_seconds is not None:
        mine = mine.withColumn(out, F.when(F.abs(_micros(F.col(f"{out}.{ts}")) - here) <= round(reach_seconds * 1e6), F.col(out)))
    lone = asked.where(~has_key([*keys, "_ts"])).select("_l", F.lit(None).cast(theirs).alias(out))
    return mine.select("_l", out).unionByName(lone).select("_l.*", out)
