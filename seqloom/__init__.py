"""seqloom: clustering and search of large sequence collections as Spark DataFrame plans."""
__version__ = "0.1.0"
