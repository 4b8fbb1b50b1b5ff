"""PySpark DataFrame operations for measuring slant and sentiment in web-crawl corpora."""
