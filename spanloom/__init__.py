"""spanloom: timed-text and interval analytics on PySpark."""
