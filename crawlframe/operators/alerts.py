"""Alert rules as data, evaluated over a table of scraped samples.

samples: (metric, job, instance, series, le, ts, value). series tells apart the
other label sets of a metric; le is a bucket's upper bound (null elsewhere).

A rule is evaluated at ticks, multiples of step seconds. A rate is the growth
of a counter, resets included, of the samples in [tick - window, tick), over
the window and without extrapolation; a gauge is its last sample within the
window. No sample, no value, and so no alert. A rule fires where it
has held at every tick of the last `lasting` seconds, this one included.

Defined cases: 0 / 0 is no value and x / 0 is infinite; of samples of one
series at one time the larger is the last; samples without ts or value are
left out; a null job, instance or series is a label of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.operators import metrics

#: Seconds of samples that a rule looks back on unless it says otherwise.
LOOKBACK = 300


@dataclass(frozen=True)
class Rule:
    """kind: rate, rate_ratio, rate_share (metric / (metric + other)), quantile, gauge_sum, gauge or gauge_ratio.

    by_instance: one value for each instance instead of one for all.
    """

    name: str
    kind: str
    metric: str
    op: str
    threshold: float
    lasting: int
    severity: str = "warning"
    other: str | None = None
    window: int = LOOKBACK
    job: str | None = None
    by_instance: bool = False
    q: float = 0.95


# The rules, their thresholds and durations in seconds. The crawler's own metrics may have a prefix (see rules).
_OWN = (
    Rule("CrawlStalled", "rate", "pages_fetched_total", "==", 0, 300, "critical"),
    Rule("HighFetchErrorRate", "rate_ratio", "fetch_errors_total", ">", 0.25, 300, other="pages_fetched_total"),
    Rule("FrontierStarvation", "gauge_sum", "frontier_size", "==", 0, 180),
    Rule("BloomSaturation", "rate_ratio", "dedup_bloom_false_positives_total", ">", 0.15, 600, other="dedup_bloom_hits_total", window=600),
    Rule("BloomSaturationCritical", "rate_ratio", "dedup_bloom_false_positives_total", ">", 0.30, 300, "critical", other="dedup_bloom_hits_total", window=600),
    Rule("HighFetchLatencyP95", "quantile", "fetch_duration_seconds_bucket", ">", 5, 300),
    Rule("HighTLSLatencyP95", "quantile", "tls_duration_seconds_bucket", ">", 2, 300),
    Rule("WARCWriteErrors", "rate", "warc_write_errors_total", ">", 0, 120, "critical"),
    Rule("InboxForwardErrors", "rate", "inbox_forward_errors_total", ">", 0, 300),
    Rule("InboxQueueBacklog", "gauge", "inbox_queue_size", ">", 100_000, 300, by_instance=True),
)
_COMMON = (
    Rule("NodeDown", "gauge", "up", "==", 0, 120, "critical", job="crawler", by_instance=True),
    Rule("HighMemory", "gauge", "process_resident_memory_bytes", ">", 3.5e9, 300, job="crawler", by_instance=True),
    Rule("HighGoroutineCount", "gauge", "go_goroutines", ">", 10_000, 300, job="crawler", by_instance=True),
    Rule("HighOpenFDs", "gauge_ratio", "process_open_fds", ">", 0.80, 300, other="process_max_fds", job="crawler", by_instance=True),
    Rule("CoreDNSDown", "gauge", "up", "==", 0, 120, "critical", job="coredns", by_instance=True),
    Rule("CoreDNSHighLatency", "quantile", "coredns_dns_request_duration_seconds_bucket", ">", 1, 300, by_instance=True),
    Rule("CoreDNSLowCacheHitRate", "rate_share", "coredns_cache_hits_total", "<", 0.5, 600, other="coredns_cache_misses_total", window=600, by_instance=True),
)


def rules(prefix: str = "") -> list[Rule]:
    """The seventeen rules; prefix goes before the names of the crawler's own metrics."""

    def named(rule: Rule) -> Rule:
        return Rule(**{**rule.__dict__, "metric": prefix + rule.metric, "other": rule.other and prefix + rule.other})

    return [*map(named, _OWN), *_COMMON]


_SERIES = ("job", "instance", "series", "le")


def _chosen(samples: DataFrame, rule: Rule, metric: str) -> DataFrame:
    rows = samples.where((F.col("metric") == metric) & F.col("ts").isNotNull() & F.col("value").isNotNull())
    if rule.job is not None:
        rows = rows.where(F.col("job") == rule.job)
    return rows.select(*_SERIES, F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def _ticks(seconds: int, step: int) -> Column:
    return F.window("ts", f"{seconds} seconds", f"{step} seconds").end.cast("long").alias("tick")


def _rates(samples: DataFrame, rule: Rule, metric: str, step: int, *by: str) -> DataFrame:
    """(tick, by, value): the summed rates of the counter's series. Growths are added up before any shuffle by tick."""
    before = F.lag("value").over(Window.partitionBy(*_SERIES).orderBy("ts", "value"))
    grown = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    rows = _chosen(samples, rule, metric).withColumn("grown", grown).where(F.col("grown").isNotNull())
    return rows.groupBy(_ticks(rule.window, step), *by).agg((F.sum("grown") / rule.window).alias("value"))


def _gauges(samples: DataFrame, rule: Rule, metric: str, step: int) -> DataFrame:
    last = F.max(F.struct("ts", "value"))["value"].alias("value")
    return _chosen(samples, rule, metric).groupBy(_ticks(rule.window, step), *_SERIES).agg(last)


def _over(a: DataFrame, b: DataFrame, keys: Sequence[str], whole: bool = False) -> DataFrame:
    """a / b, or with whole a / (a + b), where both have a value."""
    same = reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))
    x, y = a["value"], (a["value"] + b["value"] if whole else b["value"])
    ratio = F.when(y != 0, F.try_divide(x, y)).when(x != 0, F.lit(float("inf")))
    return a.join(b, same).select(*(a[k] for k in keys), ratio.alias("value"))


def values(samples: DataFrame, rule: Rule, step: int = 60) -> DataFrame:
    """(tick, instance, value) of the rule's expression; instance is null where it is one value for all."""
    by = ("instance",) if rule.by_instance else ()
    keys = ("tick", *by)
    if rule.kind == "rate":
        found = _rates(samples, rule, rule.metric, step, *by)
    elif rule.kind in ("rate_ratio", "rate_share"):
        parts = (_rates(samples, rule, m, step, *by) for m in (rule.metric, rule.other))
        found = _over(*parts, keys, whole=rule.kind == "rate_share")
    elif rule.kind == "quantile":
        buckets = _rates(samples, rule, rule.metric, step, "le", *by).withColumnRenamed("value", "n")
        found = metrics.histogram_quantile(buckets, rule.q, *keys)
    elif rule.kind == "gauge_sum":
        found = _gauges(samples, rule, rule.metric, step).groupBy(*keys).agg(F.sum("value").alias("value"))
    elif rule.kind == "gauge":
        found = _gauges(samples, rule, rule.metric, step)
    elif rule.kind == "gauge_ratio":
        a, b = (_gauges(samples, rule, m, step) for m in (rule.metric, rule.other))
        found = _over(a, b, ("tick", *_SERIES))
    else:
        raise ValueError(f"unknown kind of rule: {rule.kind}")
    series = ("job", "series") if rule.kind in ("gauge", "gauge_ratio") else ()
    none = F.lit(None).cast("string")
    return found.where(F.col("value").isNotNull()).select(
        "tick",
        (F.col("instance") if by else none).cast("string").alias("instance"),
        *((F.col(c) if c in series else none).cast("string").alias(c) for c in ("job", "series")),
        F.col("value").cast("double").alias("value"),
    )


def _holds(rule: Rule) -> Column:
    value, limit = F.col("value"), F.lit(float(rule.threshold))
    return {">": value > limit, "<": value < limit, "==": value == limit}[rule.op]


def evaluate(samples: DataFrame, chosen: Sequence[Rule], step: int = 60) -> DataFrame:
    """Rows (alert, severity, job, instance, series, tick, value, firing) of the ticks at which a rule holds.

    step divides the windows and durations of the rules.
    """

    def one(rule: Rule) -> DataFrame:
        if any(s % step for s in (rule.window, rule.lasting)):
            raise ValueError(f"step {step} doesn't divide the times of {rule.name}")
        over = Window.partitionBy("job", "instance", "series").orderBy("tick").rangeBetween(-rule.lasting, 0)
        # only ticks at which the rule holds are left, so that their number tells whether any is missing
        held = values(samples, rule, step).where(_holds(rule))
        return held.select(
            F.lit(rule.name).alias("alert"), F.lit(rule.severity).alias("severity"), "job", "instance", "series", "tick", "value",
            (F.count("*").over(over) == rule.lasting // step + 1).alias("firing"),
        )

    return reduce(DataFrame.unionByName, map(one, chosen))
