"""sparkcred: a PySpark-native engine for news-credibility data."""
