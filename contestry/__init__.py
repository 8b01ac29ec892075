"""Contest analytics as composable Spark DataFrame transforms."""

__version__ = "0.1.0"
