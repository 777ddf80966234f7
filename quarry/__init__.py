"""quarry: a Spark-first analytics engine for document retrieval workloads."""

__version__ = "0.1.0"
