"""Market time-series analytics as lazy Spark DataFrame plans."""
