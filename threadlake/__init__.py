"""threadlake: similarity search and catalogue upkeep over large file and vector
collections, written as Spark DataFrame, SQL and Structured Streaming jobs."""

__version__ = "0.1.0"
