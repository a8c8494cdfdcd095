"""Spark operators over corpora of source code held as tables."""
