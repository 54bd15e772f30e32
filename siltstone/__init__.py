"""Siltstone: a PySpark-native analytics engine for web-crawl data."""
