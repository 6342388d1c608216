"""Sources: seeds, fetched pages, robots and sitemap responses, topology, queue and state tables."""

from __future__ import annotations

import importlib
import io
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crawlframe.functions import http, robots, sitemap
from crawlframe.operators import ring
from crawlframe.schemas import NODES

BODY_BYTES = 1024 * 1024
MAX_REDIRECTS = 5
RETRIES, RETRY_WAIT = 1, 0.5


def seeds(spark: SparkSession, path: str, nodes: DataFrame | None = None, me: int | None = None) -> DataFrame:
    """(url, domain, depth) of a file with one domain on a line; blank lines and those that start with # go.

    nodes and me: only the domains that the ring of nodes gives to the node me.
    """
    domain = F.trim("value")
    lines = spark.read.text(path).where((domain != "") & ~domain.startswith("#"))
    every = lines.select(F.concat(F.lit("https://"), domain, F.lit("/")).alias("url"), domain.alias("domain"), F.lit(0).alias("depth"))
    return every if nodes is None else ring.with_owner(every, F.col("domain"), nodes).where(F.col("owner") == me).drop("owner")


def fetched(responses: DataFrame) -> DataFrame:
    """What the parser gets of (url, domain, depth, status, content_type, body, redirect_count): HTML within the redirect limit.

    A 429 is a signal and no page; other statuses with HTML are pages. Bodies are cut at BODY_BYTES.
    """
    kept = http.is_html(F.col("content_type")) & (F.col("status") != 429) & (F.coalesce("redirect_count", F.lit(0)) <= MAX_REDIRECTS)
    return responses.where(kept).withColumn("body", F.substring(F.col("body").cast("binary"), 1, BODY_BYTES))


def robots_bodies(responses: DataFrame) -> DataFrame:
    """(domain, body): a status other than 200 is an empty body, which allows all; bodies are cut."""
    body = F.when(F.col("status") == 200, F.substring("body", 1, robots.MAX_BYTES)).otherwise(F.lit(""))
    return responses.select("domain", F.coalesce(body, F.lit("")).alias("body"))


def sitemap_bodies(responses: DataFrame) -> DataFrame:
    kind = F.col("content_type")
    good = responses.where((F.col("status") == 200) & (kind.contains("xml") | kind.contains("text/")))
    return good.select("url", F.substring("body", 1, sitemap.MAX_BYTES).alias("body"))


def topology(spark: SparkSession, services: DataFrame) -> DataFrame:
    """NODES of (node_id string, service_address, node_address, redis_address): an id that isn't a number is 0."""
    address = F.coalesce(F.nullif("service_address", F.lit("")), "node_address")
    redis = F.coalesce(F.nullif("redis_address", F.lit("")), F.concat(address, F.lit(":6379")))
    number = F.coalesce(F.col("node_id").try_cast("int"), F.lit(0))
    return services.select(number.alias("node_id"), redis.alias("address")).to(spark.createDataFrame([], NODES).schema)


# Causes after which no second attempt is made.
FINAL = frozenset(("dns_nxdomain", "rate_limited", "not_retryable"))
FETCHED = "url string, status int, content_type string, body binary, error string, attempts int"


def attempt(fetch: Callable[[str], tuple], url: str, wait: Callable[[float], None] = time.sleep) -> tuple:
    """(url, status, content_type, body, error, attempts) of one URL, with at most RETRIES more attempts.

    fetch gives (status, content_type, body, error). A 429 is the error
    rate_limited, another type than HTML the error not_retryable; any other
    status with HTML is a page. Bodies are cut at BODY_BYTES; a failed fetch has none.
    """
    for n in range(RETRIES + 1):
        if n:
            wait(n * RETRY_WAIT)
        status, kind, body, error = fetch(url)
        if not error and status == 429:
            error = "rate_limited"
        elif not error and not any(t in (kind or "") for t in ("text/html", "application/xhtml")):
            error = "not_retryable"
        if not error or error in FINAL:
            break
    data = body.encode() if isinstance(body, str) else bytes(body or b"")
    return url, status, kind, None if error else data[:BODY_BYTES], error, n + 1


def _fetcher(name: str) -> Callable[[str], tuple]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def fetch_pages(urls: DataFrame, fetcher: str, partitions: int, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """FETCHED rows of a table of URLs (url), fetched by fetcher (module:function) in so many tasks at once."""

    def run(batches):
        fetch = _fetcher(fetcher)
        for batch in batches:
            rows = [attempt(fetch, u, wait) for u in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in FETCHED.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32())
    return urls.select("url").where("url IS NOT NULL").repartition(partitions).mapInArrow(run, FETCHED)


class _Part(InputPartition):
    def __init__(self, k: int):
        self.k = k


class FetchSource(DataSource):
    """FETCHED rows by a fetch function: options path (a file of URLs, one on a line, that all executors see) or urls, fetcher (module:function) and partitions.

    Network access is the function's own matter. A table of URLs goes through fetch_pages.
    """

    @classmethod
    def name(cls) -> str:
        return "crawl_fetch"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.urls = options.get("path"), options.get("urls", "")
        self.fetcher = options["fetcher"]
        self.n = int(options.get("partitions", "4"))

    def partitions(self):
        return [_Part(k) for k in range(self.n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        fetch = _fetcher(self.fetcher)
        with open(self.path) if self.path else io.StringIO(self.urls) as lines:
            for at, line in enumerate(lines):
                if at % self.n == partition.k and line.strip():
                    yield attempt(fetch, line.strip())
