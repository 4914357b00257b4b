"""larkspread: a Spark-first engine for Level-1 quote data and training-data hygiene."""

__version__ = "0.1.0"
