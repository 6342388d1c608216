"""Per-domain FIFO queues as tables: admission, caps, sequence numbers, heads, removal, wire format, key-value meta."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_URL_BYTES, MAX_DEPTH = 2048, 25
DOMAIN_CAP, GLOBAL_CAP = 1_000, 50_000_000


def admissible(url: Column, depth: Column | None = None) -> Column:
    fits = F.octet_length(url) <= MAX_URL_BYTES
    return fits if depth is None else fits & (depth <= MAX_DEPTH)


def admit(items: DataFrame, dead: DataFrame | None = None, check_depth: bool = True) -> DataFrame:
    """items (domain, url, depth) that may enter a queue; dead (domain) domains' ones don't."""
    kept = items.where(admissible(F.col("url"), F.col("depth") if check_depth else None))
    return kept if dead is None else kept.join(dead.select("domain"), "domain", "left_anti")


def enqueue(items: DataFrame, order: str, queue: DataFrame | None = None, domain_cap: int = DOMAIN_CAP) -> DataFrame:
    """items with seq, as far as their domain's cap lets them in, after what queue holds.

    row_number() <= cap is a group limit: each task cuts a hot domain to the cap before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy("domain").orderBy(order))
    cut = items.withColumn("__nth", nth).where(F.col("__nth") <= domain_cap)
    if queue is None:
        return cut.withColumn("seq", (F.col("__nth") - 1).cast("bigint")).drop("__nth")
    held = queue.groupBy("domain").agg(F.count("*").alias("__held"), (F.max("seq") + 1).alias("__base"))
    after = cut.join(held, "domain", "left").where(F.col("__nth") + F.coalesce("__held", F.lit(0)) <= domain_cap)
    return after.withColumn("seq", F.col("__nth") - 1 + F.coalesce("__base", F.lit(0))).drop("__nth", "__held", "__base")


#: Buckets of a count by order, and rows that one task may sort for the last ones that fit.
CUT_BUCKETS, CUT_ROWS = 1024, 100_000


def global_cap(items: DataFrame, total: int, *order: str, cap: int = GLOBAL_CAP) -> DataFrame:
    """items as far as the cap on all queues together, which hold total, lets them in: the first by order.

    The first column of order is a number or a time (null before all). The
    place of the cut is found by counts of ever narrower ranges, so that only the
    rows of the last range are sorted in one task, and none if all fit.
    """
    room = max(0, cap - total)
    kind = dict(items.dtypes)[order[0]]
    number = F.unix_micros(F.col(order[0]).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(order[0])
    key = F.floor(number).cast("bigint")
    n, low, high = items.agg(F.count("*"), F.min(key), F.max(key)).first()
    if n <= room:
        return items
    if low is None:
        return items.orderBy(*order).limit(room)
    key = F.coalesce(key, F.lit(low - 1))
    low, below = low - 1, 0
    while n > CUT_ROWS and high > low:
        width = (high - low) // CUT_BUCKETS + 1
        within = items.where(key.between(low, high)).groupBy(F.floor((key - low) / width).alias("k")).count()
        for k, n in sorted(within.collect()):  # CUT_BUCKETS rows at most
            if below + n > room:
                break
            below += n
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
    edge = items.where(key.between(low, high)).orderBy(*order).limit(room - below)
    return items.where(key < low).unionByName(edge)


def lengths(queue: DataFrame) -> DataFrame:
    return queue.groupBy("domain").agg(F.count("*").alias("n"))


def heads(queue: DataFrame) -> DataFrame:
    """The first item of each domain."""
    head = queue.groupBy("domain").agg(F.min_by(F.struct("url", "depth"), "seq").alias("h"), F.min("seq").alias("seq"))
    return head.select("domain", "seq", "h.url", "h.depth")


def dequeue(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the heads, what is left)."""
    first = heads(queue)
    return first, queue.join(first.select("domain", "seq"), ["domain", "seq"], "left_anti")


def drop(queue: DataFrame, domains: DataFrame) -> DataFrame:
    return queue.join(domains.select("domain"), "domain", "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of both; max_by is combined before the shuffle."""
    both = table.unionByName(changes)
    row = F.struct(*both.columns)
    return both.groupBy(key).agg(F.max_by(row, version).alias("r")).select("r.*")


def load(table: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one key, if there is one."""
    return table.where(F.col(key) == value)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def has_urls(domains: DataFrame, queue: DataFrame) -> DataFrame:
    """domains with has_urls: whether any URL of theirs is queued."""
    held = queue.select("domain", F.lit(True).alias("has_urls")).distinct()
    return domains.join(held, "domain", "left").withColumn("has_urls", F.coalesce("has_urls", F.lit(False)))


def union(*streams: DataFrame) -> DataFrame:
    """Items (domain, url, depth, origin, arrival) of all ways into a queue: seeds, links, sitemaps, inbox, rate-limited ones."""
    columns = ("domain", "url", "depth", "origin", "arrival")
    return reduce(DataFrame.unionByName, (s.select(*columns) for s in streams))


def encode_seq(seq: Column) -> Column:
    """A sequence number as a key of eight big-endian bytes, which sort as the numbers do."""
    return F.unhex(F.lpad(F.hex(seq), 16, "0"))


def encode_value(url: Column, depth: Column) -> Column:
    """A queue entry's bytes: the depth as a zigzag variable-length integer (up to 27 bits), then the URL."""
    zigzag = F.shiftleft(depth, 1).bitwiseXOR(F.shiftright(depth, 31))
    byte = lambda k, more: F.lpad(F.hex(F.shiftright(zigzag, 7 * k).bitwiseAND(F.lit(127)) + (128 if more else 0)), 2, "0")
    out = F.lit(None).cast("string")
    for n in (4, 3, 2, 1):
        out = F.when(zigzag < 1 << 7 * n, F.concat(*(byte(k, k < n - 1) for k in range(n)))).otherwise(out)
    return F.concat(F.unhex(out), F.encode(url, "utf-8"))


def decode_value(value: Column) -> Column:
    """struct(url, depth) of an entry's bytes."""
    digits = F.hex(value)
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int")
    out, number = F.lit(None), F.lit(0)
    for k in range(4):
        number = number + F.shiftleft(byte(k).bitwiseAND(F.lit(127)), 7 * k)
        found = F.struct(
            F.decode(F.substring(value, k + 2, 1 << 20), "utf-8").alias("url"),
            F.shiftrightunsigned(number, 1).bitwiseXOR(-number.bitwiseAND(F.lit(1))).cast("int").alias("depth"),
        )
        out = F.when((byte(k) < 128) & reduce(lambda a, b: a & b, (byte(j) >= 128 for j in range(k)), F.lit(True)), found) if k == 0 else F.when(
            out.isNotNull(), out
        ).when((byte(k) < 128) & reduce(lambda a, b: a & b, (byte(j) >= 128 for j in range(k)), F.lit(True)), found)
    return out


def decode_seq(key: Column) -> Column:
    return F.conv(F.hex(key), 16, 10).cast("bigint")


def peer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, change): reuse, open or close a connection."""
    o, n = old.alias("o"), new.alias("n")
    change = F.when(F.col("o.address").isNull(), "open").when(F.col("n.address").isNull(), "close").when(
        F.col("o.address") == F.col("n.address"), "reuse"
    ).otherwise("open")
    return o.join(n, F.col("o.node_id") == F.col("n.node_id"), "full").select(
        F.coalesce("o.node_id", "n.node_id").alias("node_id"), change.alias("change")
    )
