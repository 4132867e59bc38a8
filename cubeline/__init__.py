"""Event metering and time-series analytics as Spark plans."""
