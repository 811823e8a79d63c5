"""Survey-quality and cluster-inference operators written as Spark DataFrame plans."""

__version__ = "0.1.0"
