"""wardspark: security analytics over agent code, configs and text tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
