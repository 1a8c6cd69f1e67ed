"""trawldex: a PySpark-native engine for crawled text (index, search, statistics)."""

__version__ = "0.1.0"
