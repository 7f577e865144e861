"""Battery-telemetry analytics for electric vehicles, written as plain PySpark."""
