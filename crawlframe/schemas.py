"""Schemas of the crawl's tables."""

from __future__ import annotations

QUEUE = "domain string, seq bigint, url string, depth int"
PAGES = "url string, domain string, depth int, body string, status int"
FRONTIER = "domain string, next_fetch timestamp"
STATE = (
    "domain string, dead boolean, sitemap_checked boolean, crawl_delay_ns bigint, robots_delay_ns bigint, "
    "avg_latency_ns bigint, last_fetch_ns bigint, backoff_until_ns bigint, consecutive_errors int"
)
NODES = "node_id int, address string"
SAMPLES = "ts timestamp, instance string, metric string, labels map<string, string>, le double, value double"
