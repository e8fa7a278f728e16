"""skriva: hybrid text retrieval and corpus processing as PySpark programs."""

__version__ = "0.1.0"
