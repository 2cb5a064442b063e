"""Scalar functions on columns: formats, dates, market hours and small helpers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(v: Column) -> Column:
    """US dollars, two decimals, grouped; a minus goes before the sign."""
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 2))


def fixed(v: Column, decimals: int) -> Column:
    """Decimals as C's printf writes them: rounded by the exact binary value (1.005 is 1.00), ties to even. From 2^63 on, digits after the 17th may be zeros."""
    size, point = F.abs(v), "." + "0" * decimals if decimals else ""
    whole = F.when(size < 2.0**63, F.concat(v.cast("long").cast("string"), F.lit(point))).otherwise(F.translate(F.format_number(v, decimals), ",", ""))
    told = F.when(size < 2.0**53, F.translate(F.format_number(v, decimals), ",", "")).when(F.isnan(v), "nan").when(size == float("inf"), F.when(v < 0, "-inf").otherwise("inf")).otherwise(whole)
    return F.when(v.isNotNull(), told)


def percent(v: Column, decimals: int = 2) -> Column:
    return F.concat(F.when(v >= 0, "+").otherwise(""), fixed(v, decimals), F.lit("%"))


def plain_number(v: Column) -> Column:
    """A number as short as it can be: whole numbers without a point."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def _scaled(v: Column, by: float, decimals: int, suffix: str, prefix: str = "") -> Column:
    return F.format_string(f"{prefix}%.{decimals}f{suffix}", v / by)


def number(v: Column, largest: str = "T") -> Column:
    """Compact notation with at most one decimal, halves away from zero: 1.2K, 3M, 4.5B, 6T, or up to the unit `largest`."""
    size, out = F.abs(v), F  # F.when first, then Column.when
    units = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (0.0, ""))
    for least, suffix in units[[u for _, u in units].index(largest) :]:
        short = F.regexp_replace(fixed(F.round(size / (least or 1.0) * 10, 0) / 10, 1), r"\.0$", "")
        out = out.when(size >= least, F.concat(F.when(v < 0, "-").otherwise(""), short, F.lit(suffix)))
    return out


def volume(v: Column) -> Column:
    return F.when(v >= 1e9, _scaled(v, 1e9, 1, "B")).when(v >= 1e6, _scaled(v, 1e6, 1, "M")).when(v >= 1e3, _scaled(v, 1e3, 1, "K")).otherwise(plain_number(v))


def dollar_volume(v: Column) -> Column:
    """Everything below a million is in thousands without decimals."""
    return F.when(v >= 1e12, _scaled(v, 1e12, 1, "T", "$")).when(v >= 1e9, _scaled(v, 1e9, 1, "B", "$")).when(v >= 1e6, _scaled(v, 1e6, 1, "M", "$")).otherwise(_scaled(v, 1e3, 0, "K", "$"))


def compact_volume(v: Column) -> Column:
    return F.when(v >= 1e9, _scaled(v, 1e9, 1, "B")).when(v >= 1e6, _scaled(v, 1e6, 1, "M")).when(v >= 1e3, _scaled(v, 1e3, 0, "K")).otherwise(plain_number(v))


def half_up(v: Column, decimals: int = 2) -> Column:
    """Rounds halves towards positive infinity."""
    scale = 10.0**decimals
    return F.floor(v * scale + 0.5) / scale


def half_away(v: Column, decimals: int = 2) -> Column:
    """Rounds halves away from zero without the decimals that round() makes of each value: for small values of very many rows."""
    scale = 10.0**decimals
    return F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale


def date_part(iso: Column) -> Column:
    """The day of an ISO-8601 text."""
    return F.substring_index(iso, "T", 1)


def axis_label(day: Column, range_name: str) -> Column:
    """Month and year for long ranges, else month and day."""
    return F.date_format(day, "MMM yy" if range_name in ("5Y", "ALL") else "MM/dd")


def month_day(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def short_date(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def day_distance(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def year_fraction(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


def market_open(ts: Column) -> Column:
    """Whether a UTC time is on a weekday from 9:30 to 16:00 in New York, both ends included; holidays aren't known."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & minute.between(570, 960)


def refresh_seconds(ts: Column, auto: bool = True) -> Column:
    """Seconds until quotes should be read again: 30 in market hours, 300 outside, null if turned off."""
    return F.when(market_open(ts), 30).otherwise(300) if auto else F.lit(None).cast("int")


def bar_direction(open_: Column, close: Column) -> Column:
    return F.when(close >= open_, "up").otherwise("down")


def sign_class(v: Column) -> Column:
    return F.when(v >= 0, "positive").otherwise("negative")


def is_open_state(state: Column) -> Column:
    return F.coalesce(state == "REGULAR", F.lit(False))


def instrument_class(symbol: Column, futures: str = "GC=F", miners: str = "GDX") -> Column:
    return F.when(symbol == futures, "futures").when(symbol == miners, "miners").otherwise("fund")


def lookup(key: Column, values: dict[str, str], default: str) -> Column:
    """A value for a key from a small fixed table."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def toggle(items: Column, item: Column) -> Column:
    """Takes an item out of an array that has it, appends it otherwise."""
    return F.when(F.array_contains(items, item), F.array_remove(items, item)).otherwise(F.array_append(items, item))


def fallback(v: Column, default) -> Column:
    """default where v is null, 0, nan or empty."""
    return F.when(v.isNull() | (v.cast("string").isin("0", "0.0", "-0.0", "NaN", "")), F.lit(default)).otherwise(v)


def equal_weight(n: Column, position: Column) -> Column:
    """Whole percents for n members that add up to 100: the last takes what rounding leaves. position counts from 1."""
    each = F.floor(F.lit(100.0) / n + 0.5)
    return F.when(position == n, 100 - each * (n - 1)).otherwise(each).cast("int")


def order_of(key: Column, keys: list[str], default: int = 99) -> Column:
    """The place of a key in a fixed order, from 0; unknown keys come last."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, k in enumerate(keys) for x in (k, i))), key), F.lit(default))
