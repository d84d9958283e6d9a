"""webgrain: a PySpark-native analytics engine for crawled web pages."""
