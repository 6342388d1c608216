"""The frontier: domains by the time from which they may be fetched, and the politeness state that sets it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import politeness as P
from crawlframe.functions.binding import let


def push(frontier: DataFrame, entries: DataFrame) -> DataFrame:
    """(domain, next_fetch): an entry replaces a later one only."""
    return frontier.unionByName(entries).groupBy("domain").agg(F.min("next_fetch").alias("next_fetch"))


def pop_ready(frontier: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """The k domains that have been ready longest; ties by name."""
    return frontier.where(F.col("next_fetch") <= now).orderBy("next_fetch", "domain").limit(k)


def wait(frontier: DataFrame, now: Column) -> DataFrame:
    """One row (wait): how long the earliest domain isn't ready yet; 0 if one is ready or there is none."""
    return frontier.agg(F.greatest(F.coalesce(F.min("next_fetch") - now, F.lit(0)), F.lit(0)).cast("bigint").alias("wait"))


def peek(frontier: DataFrame) -> DataFrame:
    return frontier.orderBy("next_fetch", "domain").limit(1)


def remove(frontier: DataFrame, domains: DataFrame) -> DataFrame:
    return frontier.join(domains.select("domain"), "domain", "left_anti")


def contains(frontier: DataFrame, domains: DataFrame) -> DataFrame:
    """domains with held: whether the frontier has them."""
    held = frontier.select("domain", F.lit(True).alias("held")).distinct()
    return domains.join(held, "domain", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count("*").alias("n"))


def rebuild(queue: DataFrame, state: DataFrame, now_ns: Column) -> DataFrame:
    """(domain, next_fetch_ns) of the queued domains that aren't dead. state is read once, as it may be a whole fold."""
    known = state.select("domain", "dead", "last_fetch_ns", "crawl_delay_ns", "backoff_until_ns")
    active = queue.select("domain").distinct().join(known, "domain", "left").where(~F.coalesce("dead", F.lit(False)))
    due = P.next_fetch(now_ns, F.col("last_fetch_ns"), F.coalesce("crawl_delay_ns", F.lit(P.DEFAULT_DELAY)), F.col("backoff_until_ns"))
    return active.select("domain", due.alias("next_fetch_ns"))


STATE = "domain string, dead boolean, crawl_delay_ns bigint, avg_latency_ns bigint, last_fetch_ns bigint, backoff_until_ns bigint, consecutive_errors int"


def fold(log: DataFrame, compat: bool = False) -> DataFrame:
    """The politeness state (STATE) of each domain after log (event_id, ts_ns, domain, outcome, latency_ns, robots_delay_ns[, retry_after_ns]).

    outcome: ok, rate_limited, error or nxdomain; see politeness.step. Each step
    cuts to whole nanoseconds, so the fold is in order: a task reads its
    domains' events sorted and holds one state at a time, so that memory is
    bounded however long a domain's log is (the sort spills).
    """
    if "retry_after_ns" not in log.columns:
        log = log.withColumn("retry_after_ns", F.lit(None).cast("bigint"))
    names = [c.split()[0] for c in STATE.split(", ")]
    kinds = (pa.string(), pa.bool_(), *(pa.int64(),) * 4, pa.int32())

    def run(batches):
        domain, state, started = None, P.FRESH, False

        def out(rows):
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for name, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or name != domain:
                    if started:
                        done.append((domain, *state))
                    domain, state, started = name, P.FRESH, True
                state = P.advance(state, *event, compat)
            yield out(done)
        if started:
            yield out([(domain, *state)])

    ordered = log.repartition("domain").sortWithinPartitions("domain", "ts_ns", "event_id")
    return ordered.select("domain", "outcome", "ts_ns", "latency_ns", "robots_delay_ns", "retry_after_ns").mapInArrow(run, STATE)


def record(state: DataFrame, events: DataFrame, compat: bool = False) -> DataFrame:
    """state (STATE) after at most one event of each domain; a domain without state starts afresh. Native, one join."""
    old = F.struct(
        F.coalesce("dead", F.lit(False)).alias("dead"), F.coalesce("crawl_delay_ns", F.lit(P.DEFAULT_DELAY)).alias("delay"),
        F.coalesce("avg_latency_ns", F.lit(0)).alias("ema"), F.col("last_fetch_ns").alias("last"),
        F.col("backoff_until_ns").alias("backoff"), F.coalesce("consecutive_errors", F.lit(0)).alias("errors"),
    )
    event = F.struct("ts_ns", "outcome", "latency_ns", "robots_delay_ns", "retry_after_ns")
    joined = state.join(events.select("domain", event.alias("e")), "domain", "full")
    after = let(old, lambda s: F.when(F.col("e").isNull(), s).otherwise(P.step(s, F.col("e"), compat)))
    return joined.select("domain", after.alias("s")).select(
        "domain", "s.dead", F.col("s.delay").alias("crawl_delay_ns"), F.col("s.ema").alias("avg_latency_ns"),
        F.col("s.last").alias("last_fetch_ns"), F.col("s.backoff").alias("backoff_until_ns"), F.col("s.errors").alias("consecutive_errors"),
    )


def error_runs(log: DataFrame) -> DataFrame:
    """(domain, run, n): the lengths of stretches of errors between successes."""
    order = Window.partitionBy("domain").orderBy("ts_ns", "event_id")
    island = log.withColumn("run", F.sum(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(order))
    return island.where("outcome = 'error'").groupBy("domain", "run").agg(F.count("*").alias("n"))


def worker_change(fill_percent: Column, workers: Column, least: int, most: int, low_ticks: Column) -> Column:
    """struct(change, low_ticks): the parse pool's autoscaler at one tick."""
    grow4 = F.least(F.lit(4), F.lit(most) - workers)
    low = low_ticks + 1
    out = lambda n, ticks: F.struct(F.lit(n).alias("change") if isinstance(n, int) else n.alias("change"), F.lit(ticks).alias("low_ticks") if isinstance(ticks, int) else ticks.alias("low_ticks"))  # noqa: E731, E501
    return (
        F.when((fill_percent > 80) & (workers < most), out(grow4, 0))
        .when((fill_percent > 50) & (workers < most), out(1, 0))
        .when((fill_percent < 10) & (workers > least), F.when(low >= 6, out(-1, 0)).otherwise(out(0, low)))
        .otherwise(out(0, 0))
    )
