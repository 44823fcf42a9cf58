"""tidemark: degradation-series analytics and measurement audits on PySpark."""

__version__ = "0.1.0"
