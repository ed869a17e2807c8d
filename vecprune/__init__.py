"""Near-duplicate pruning of embedded items, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
