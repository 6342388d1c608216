"""Consistent hashing of domains to nodes: a ring of virtual nodes and an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.hashing import fnv1a64_hex

VNODES = 128


def build(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(pos, node_id): the positions of each node's virtual nodes. vnodes below 1 is VNODES."""
    n = vnodes if vnodes > 0 else VNODES
    each = nodes.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    name = F.concat(F.lit("node-"), F.col("node_id").cast("string"), F.lit("-vnode-"), F.col("k").cast("string"))
    return each.select(fnv1a64_hex(name).alias("pos"), "node_id")


def node(nodes: DataFrame, node_id: int) -> DataFrame:
    """The row of one node, if there is one."""
    return nodes.where(F.col("node_id") == node_id)


def count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_distinct("node_id").alias("n"))


def intervals(ring: DataFrame) -> DataFrame:
    """(lo, hi, node_id): the hashes in (lo, hi] belong to node_id; the last stretch wraps to the first node. A few hundred rows a node."""
    order = Window.orderBy("pos")
    rows = ring.withColumn("lo", F.lag("pos").over(order)).select(F.coalesce("lo", F.lit("")).alias("lo"), F.col("pos").alias("hi"), "node_id")
    first = ring.agg(F.min_by("node_id", "pos").alias("node_id"), F.max("pos").alias("lo"))
    return rows.unionByName(first.where("lo IS NOT NULL").select("lo", F.lit("g").alias("hi"), "node_id"))


def with_owner(rows: DataFrame, domain: Column, nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """rows with owner: the node of the first position at or after the domain's hash; -1 on an empty ring.

    Intervals are dealt to the first two hex digits they reach over, so that the
    join has an equality and looks at two or three intervals for each row.
    """
    digit = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    ends = F.coalesce(digit(F.nullif("lo", F.lit(""))), F.lit(0)), F.when(F.col("hi") == "g", 255).otherwise(digit(F.col("hi")))
    spread = intervals(build(nodes, vnodes)).select("lo", "hi", F.col("node_id").alias("owner"), F.explode(F.sequence(*ends)).alias("slot"))
    hashed = rows.withColumn("__hash", fnv1a64_hex(domain))
    inside = (F.col("__hash") > F.col("lo")) & (F.col("__hash") <= F.col("hi")) & (digit(F.col("__hash")) == F.col("slot"))
    joined = hashed.join(F.broadcast(spread), inside, "left")  # vnodes rows a node, and 256
    return joined.select(*rows.columns, F.coalesce("owner", F.lit(-1)).alias("owner"))
