"""Streaming forms: URL dedup, soft-404, politeness state, inbox and crawl rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlframe.functions import politeness as P
from crawlframe.functions.hashing import fnv1a64_hex
from crawlframe.functions.http import decode_wire
from crawlframe.functions.urls import extract_domain
from crawlframe.operators import queue
from crawlframe.operators.links import SOFT404

STATE = "dead boolean, delay bigint, ema bigint, last bigint, backoff bigint, errors int"
OUT = "domain string, dead boolean, crawl_delay_ns bigint, avg_latency_ns bigint, last_fetch_ns bigint, backoff_until_ns bigint, consecutive_errors int"


def new_urls(urls: DataFrame, url: str = "url", event_time: str | None = None, within: str = "7 days") -> DataFrame:
    """URLs not met before: for ever, or within a watermark that bounds the state."""
    keyed = urls.withColumn("url_key", fnv1a64_hex(F.col(url)))
    if event_time is None:
        return keyed.dropDuplicates(["url_key"])
    return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["url_key"])


step = P.advance


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Events of a micro-batch in their order; only the numbers of them are held, not a joined frame."""
    own = state.get if state.exists else P.FRESH
    known = lambda x: None if pd.isna(x) else int(x)
    events = sorted(
        (e.ts_ns, e.event_id, e.outcome, known(e.latency_ns), known(e.robots_delay_ns), known(getattr(e, "retry_after_ns", None)))
        for batch in batches
        for e in batch.itertuples(index=False)
    )
    for ts, _, outcome, latency, robots, retry in events:
        own = P.advance(own, outcome, int(ts), latency, robots, retry)
    state.update(own)
    yield pd.DataFrame([[key[0], *own]], columns=[c.split()[0] for c in OUT.split(", ")])


def politeness(log: DataFrame) -> DataFrame:
    """Each domain's state after each micro-batch of log (event_id, ts_ns, domain, outcome, latency_ns, robots_delay_ns)."""
    return log.groupBy("domain").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def soft404(pages: DataFrame, order: str, ttl: str = "24 hours", threshold: int = SOFT404) -> DataFrame:
    """pages (domain, html, ...) without the threshold-th and later copies of a body within a domain, by arrival and within a batch by order.

    The state is one count for each domain and body, and goes when no copy has
    come for ttl, so that it is bounded by the bodies of that time.
    """
    schema = pages.schema
    names = schema.fieldNames()
    milliseconds = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        before = state.get[0] if state.exists else 0
        state.update((min(before + len(rows), threshold),))
        state.setTimeoutDuration(milliseconds)
        yield rows[names].head(max(0, threshold - 1 - before))

    keyed = pages.withColumn("__body", F.xxhash64("html"))
    return keyed.groupBy("domain", "__body").applyInPandasWithState(count, schema, "n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def inbox(wires: DataFrame) -> DataFrame:
    """(url, domain, depth) of new URLs among wire messages (value); the first of equal ones keeps its depth."""
    decoded = wires.select(decode_wire(F.col("value")).alias("m")).select("m.url", "m.depth")
    fresh = new_urls(decoded)
    return fresh.select("url", extract_domain(F.col("url")).alias("domain"), "depth").where(queue.admissible(F.col("url"), F.col("depth")))


def rounds(pages: DataFrame, crawl: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """Run crawl over each micro-batch of pages and append what it returns under the batch's id: a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        crawl(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
