"""The inbox: URLs that other nodes send, taken in batches, deduplicated and queued."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.http import decode_wire
from crawlframe.functions.urls import extract_domain
from crawlframe.operators import queue

#: Messages of one batch.
BATCH = 500


class Received(NamedTuple):
    """items: (domain, seq, url, depth) that enter the queues; new: (url) to be marked as seen; rest: the messages left."""

    items: DataFrame
    new: DataFrame
    rest: DataFrame


def receive(wires: DataFrame, seen: DataFrame, queued: DataFrame, batch: int = BATCH) -> Received:
    """One batch of wires (arrival, value), the latest first, as the list is pushed and popped at one end.

    Its URLs are deduplicated first, against seen (url) and each other, then
    admitted by length and depth (dead domains aren't looked at) and put at the
    ends of their queues within the domains' cap.
    """
    edge = wires.orderBy(F.desc("arrival")).limit(batch)
    taken = edge.select("arrival", decode_wire(F.col("value")).alias("m")).select((-F.col("arrival")).alias("order"), "m.url", "m.depth")
    nth = F.row_number().over(Window.partitionBy("url").orderBy("order"))
    new = taken.withColumn("nth", nth).where("nth = 1").drop("nth").join(seen.select("url"), "url", "left_anti")
    named = new.withColumn("domain", extract_domain(F.col("url")))
    items = queue.enqueue(queue.admit(named), "order", queued).select("domain", "seq", "url", "depth")
    return Received(items, new.select("url"), wires.join(edge.select("arrival"), "arrival", "left_anti"))
