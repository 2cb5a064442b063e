"""Explicit schemas; nothing is inferred."""

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
QUOTES = "symbol string, short_name string, price double, previous_close double, change double, change_percent double, day_high double, day_low double, volume double, market_state string, ts timestamp_ntz"
ALLOCATIONS = "symbol string, weight double"
INSTRUMENTS = "ordinal int, symbol string, name string, multiplier double"
SOURCES = "ordinal int, key string, name string, percent double, color string"
REGIONS = "region string, percent double, color string, countries array<struct<country:string,flag:string,percent:double,breakdown:array<struct<type:string,percent:double,color:string>>>>"
EVENTS = "ordinal int, event_date date, title string, description string"
