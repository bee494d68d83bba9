"""sparkseries: time-series, graph, schema and binary-format analytics on PySpark."""

__version__ = "0.1.0"
