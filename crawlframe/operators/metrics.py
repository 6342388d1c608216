"""Crawl metrics: counters, histograms, rates over windows, bucket quantiles and alerts that hold for a while."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds of the histograms' buckets.
DURATION = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
FAST_DURATION = DURATION[:12]
SIZE = (1024.0, 5120.0, 10240.0, 51200.0, 102400.0, 256000.0, 512000.0, 1048576.0, 2097152.0, 5242880.0, 10485760.0)
LINKS = (0.0, 1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
BATCH = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], *by: str) -> DataFrame:
    """(by, le, n): cumulative counts; the last bucket is infinity. One pass with one conditional count for each bound."""
    counts = [F.count_if(F.col(value) <= b).alias(str(k)) for k, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(str(k)).alias("n")) for k, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*by, F.inline(F.array(*cells)))


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """(by, value): linear within the first bucket that reaches the share q; within the infinite one, its lower bound.

    Buckets of a label set are few, whatever the number of samples.
    """
    order = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rank = F.lit(q) * F.col("all")
    steps = buckets.withColumns(
        {
            "below": F.coalesce(F.lag("n").over(order), F.lit(0)),
            "from": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "all": F.max("n").over(whole),
        }
    ).where((F.col("n") >= rank) & (F.col("below") < rank))
    within = F.col("from") + (F.col("le") - F.col("from")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))
    value = F.when(F.col("le") == float("inf"), F.col("from")).otherwise(within)
    return steps.select(*by, value.alias("value"))


def increase(samples: DataFrame, window: str, *by: str) -> DataFrame:
    """(by, window start, increase) of counters (ts, value): a fall is a reset, from which counting starts at 0."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("ts"))
    grown = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return (
        samples.withColumn("grown", grown)
        .groupBy(*by, F.window("ts", window).start.alias("start"))
        .agg(F.sum("grown").alias("increase"))
    )


def rate(samples: DataFrame, window: str, seconds: float, *by: str) -> DataFrame:
    grown = increase(samples, window, *by)
    return grown.select(*by, "start", (F.col("increase") / seconds).alias("rate"))


def share(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def last_gauge(samples: DataFrame, *by: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.max_by("value", "ts").alias("value"))


def holding(ticks: DataFrame, condition: str, lasting: int, *by: str, order: str = "start") -> DataFrame:
    """ticks with firing: the condition has held on this and the lasting ticks before."""
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(-lasting, 0)
    held = (F.min(F.col(condition).cast("int")).over(over) == 1) & (F.count("*").over(over) == lasting + 1)
    return ticks.withColumn("firing", held)
