"""Crawl data processing on PySpark: batch and streaming operators over pages, URLs, queues and metrics."""
