"""Event-driven time-series analytics on Spark."""
