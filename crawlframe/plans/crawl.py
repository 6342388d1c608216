"""Whole plans: the parse loop from pages to routed new URLs, the fetch loop, robots gating and its cache, sitemap recursion."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions import robots, sitemap
from crawlframe.functions.http import encode_wire
from crawlframe.functions.urls import robots_path
from crawlframe.operators import dedup, frontier, links, queue, ring, store

ROBOTS_TTL_NS = 24 * 3600 * 10**9


def crawl_round(pages: DataFrame, seen: DataFrame, nodes: DataFrame, depth: Column | None = None) -> DataFrame:
    """(url, domain, depth, owner): the new URLs of pages (page_id, url, html) and the node that each belongs to.

    Narrow up to the dedup; one shuffle by URL; the ring is broadcast.
    """
    found = links.resolve(links.extract(pages))
    child = (F.lit(0) if depth is None else depth) + 1
    each = found.select(F.col("link").alias("url"), F.col("link_domain").alias("domain"), child.alias("depth"))
    fresh = dedup.new_urls(queue.admit(each), seen)
    return ring.with_owner(fresh, F.col("domain"), nodes)


def robots_gate(urls: DataFrame, bodies: DataFrame, agent: str) -> DataFrame:
    """urls (url, domain) with allowed and robots_delay_ns; a domain without an answer allows all."""
    group = robots.chosen_group(robots.groups(F.col("body")), agent)
    parsed = bodies.select("domain", group.alias("g")).select(
        "domain", F.col("g.rules").alias("rules"), (F.col("g.delay") * 1e9).cast("bigint").alias("robots_delay_ns")
    )
    joined = urls.join(parsed, "domain", "left")
    return joined.withColumn("allowed", robots.allowed(robots_path(F.col("url")), F.col("rules"))).drop("rules")


def robots_due(domains: DataFrame, cache: DataFrame, now_ns: Column) -> DataFrame:
    """The domains whose robots.txt is to be fetched: the cache (domain, expires_ns) has no answer of theirs that still holds."""
    valid = cache.where(F.col("expires_ns") > now_ns).select("domain")
    return domains.select("domain").distinct().join(valid, "domain", "left_anti")


def robots_refreshed(cache: DataFrame, bodies: DataFrame, now_ns: Column) -> DataFrame:
    """The cache (domain, body, expires_ns) with newly fetched bodies (domain, body), which hold for ROBOTS_TTL_NS."""
    fresh = bodies.select("domain", "body", (now_ns + ROBOTS_TTL_NS).alias("expires_ns"))
    return cache.join(bodies.select("domain"), "domain", "left_anti").select("domain", "body", "expires_ns").unionByName(fresh)


def sitemap_candidates(hints: DataFrame) -> DataFrame:
    """(domain, pos, url) of (domain, hints): the default place, then distinct trimmed hints."""
    default = F.concat(F.lit("https://"), F.col("domain"), F.lit("/sitemap.xml"))
    told = F.filter(F.transform(F.coalesce("hints", F.array()), lambda h: F.trim(h)), lambda h: h != "")
    return hints.select("domain", F.posexplode(F.array_distinct(F.concat(F.array(default), told))).alias("pos", "url"))


def sitemap_due(domains: DataFrame, checked: DataFrame) -> DataFrame:
    """The domains (domain, hints) whose sitemaps were never looked for: each is once, whatever comes of it."""
    return domains.join(checked.select("domain"), "domain", "left_anti")


def sitemap_urls(roots: DataFrame, bodies: DataFrame, depth: int = 2) -> DataFrame:
    """(domain, pos, url): pages of the sitemaps (url, body) under roots (domain, pos, url), through indexes up to depth.

    In document order, root after root, each URL at its first place. A root
    gives at most MAX_URLS, repeated ones counted, and so does a domain; of an
    index all entries are followed, as many of them may give nothing.
    """
    level = roots.select("domain", F.col("pos").alias("root"), F.lit(None).cast("array<int>").alias("path"), "url")
    pages = []
    for k in range(depth + 1):
        opened = level.join(bodies, "url")
        place = F.concat(F.coalesce("path", F.array().cast("array<int>")), F.array(F.col("at")))
        tell = lambda rows, tag, most: rows.select("domain", "root", "path", F.posexplode(sitemap.locs(F.col("body"), tag, most)).alias("at", "url")).select(
            "domain", "root", place.alias("path"), "url"
        )
        pages.append(tell(opened.where(~sitemap.is_index(F.col("body"))), "url", sitemap.MAX_URLS))  # a root gives no more
        if k < depth:
            level = tell(opened.where(sitemap.is_index(F.col("body"))), "sitemap", None)
    within = Window.partitionBy("domain", "root").orderBy("path")
    capped = reduce(DataFrame.unionByName, pages).withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= sitemap.MAX_URLS)
    first = capped.groupBy("domain", "url").agg(F.min(F.struct("root", "nth")).alias("first"))
    pos = F.row_number().over(Window.partitionBy("domain").orderBy("first"))
    return first.select("domain", pos.alias("pos"), "url").where(F.col("pos") <= sitemap.MAX_URLS)


class Parsed(NamedTuple):
    """new: (url, domain, depth, owner) of new URLs; enqueued: those of this node as queue items; forwarded: (owner, address, wire); counters: a row for each page."""

    new: DataFrame
    enqueued: DataFrame
    forwarded: DataFrame
    counters: DataFrame


def parse_round(pages: DataFrame, seen: DataFrame, queued: DataFrame, dead: DataFrame, nodes: DataFrame, me: int) -> Parsed:
    """The parse loop over pages (page_id, url, domain, depth, html), in the order of page_id.

    The third and later pages of a domain with one body give no links. Of the
    links of all other pages, those that seen (url) has or that an earlier place
    has are dropped; the others go to the node that owns their domain: this one
    (me) enqueues them within the caps, after what queued (domain, seq) holds,
    unless the domain is dead; others get them by their address, and a node
    without one gets nothing. Counters, as the pages count them: discovered,
    deduped, enqueued (before caps), forwarded.
    """
    kept = links.soft404(pages.withColumn("__body", F.xxhash64("html")), "domain", "__body", "page_id").drop("__body")
    each = links.first_seen(links.resolve(links.extract(kept)), "page_id").join(kept.select("page_id", (F.col("depth") + 1).alias("depth")), "page_id")
    place = F.struct("page_id", "pos")
    first = each.groupBy("link").agg(F.min(F.struct(place.alias("place"), "link_domain", "depth")).alias("f")).select(
        F.col("link").alias("url"), F.col("f.link_domain").alias("domain"), "f.depth", F.col("f.place.page_id").alias("page_id"), F.col("f.place.pos").alias("pos")
    )
    fresh = ring.with_owner(dedup.new_urls(first, seen), F.col("domain"), nodes)
    own = queue.admit(fresh.where(F.col("owner") == me), dead).withColumn("__at", F.struct("page_id", "pos"))
    enqueued = queue.enqueue(own, "__at", queued).select("domain", "seq", "url", "depth")
    peers = nodes.where(F.col("node_id") != me).select(F.col("node_id").alias("owner"), "address")
    sent = fresh.join(F.broadcast(peers), "owner").select("owner", "address", encode_wire(F.col("url"), F.col("depth")).alias("wire"))  # nodes are few
    found = each.groupBy("page_id").agg(F.count("*").alias("discovered"))
    new = fresh.groupBy("page_id").agg(F.count_if(F.col("owner") == me).alias("enqueued"), F.count_if(F.col("owner") != me).alias("forwarded"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counters = kept.select("page_id").join(found, "page_id", "left").join(new, "page_id", "left").select(
        "page_id", none("discovered"), none("enqueued"), none("forwarded")
    ).withColumn("deduped", F.col("discovered") - F.col("enqueued") - F.col("forwarded"))
    return Parsed(fresh.select("url", "domain", "depth", "owner"), enqueued, sent, counters)


class Fetched(NamedTuple):
    """outcomes: (domain, url, depth, outcome) of each URL taken; pages, queue, state and frontier after the round."""

    outcomes: DataFrame
    pages: DataFrame
    queue: DataFrame
    state: DataFrame
    frontier: DataFrame


def fetch_round(front: DataFrame, queued: DataFrame, state: DataFrame, bodies: DataFrame, responses: DataFrame, agent: str, now_ns: Column, k: int, compat: bool = False) -> Fetched:
    """One turn of the fetch loop for the k domains of front (domain, next_fetch) that have been ready longest.

    Each gives the head of its queue (domain, seq, url, depth). A dead domain's
    URL is lost, and the domain isn't put back. A URL that robots.txt (domain,
    body) forbids is lost. The others are looked up in responses (url, outcome,
    latency_ns, retry_after_ns, body); one without a response is an error. A rate-limited
    URL goes to its queue's end. Outcomes are recorded in state; a domain that
    dies loses its queue. A domain with URLs left comes back with its next time.

    The rows of the k domains are set apart and kept (store.materialise), and all
    that happens is worked out on them; the other domains' rows go on as they are.
    front, queued and state are read more than once, so that they should be tables.
    """
    popped = store.materialise(frontier.pop_ready(front, now_ns, k).select("domain"), "popped")
    of_popped = lambda rows: rows.join(popped, "domain", "left_semi")
    others = lambda rows: rows.join(popped, "domain", "left_anti")
    mine, known = store.materialise(of_popped(queued), "popped_queues"), store.materialise(of_popped(state), "popped_states")
    taken = store.materialise(queue.heads(mine), "taken")
    alive = taken.join(known.where("dead").select("domain"), "domain", "left_anti")
    gated = store.materialise(robots_gate(alive, of_popped(bodies), agent), "gated")
    allowed = gated.where("allowed").drop("allowed")
    answers = responses.join(allowed.select("url"), "url", "left_semi")
    asked = store.materialise(allowed.join(answers, "url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("error"))), "asked")
    lost = taken.join(alive.select("domain"), "domain", "left_anti").withColumn("outcome", F.lit("dead")).select("domain", "url", "depth", "outcome")
    blocked = gated.where("NOT allowed").select("domain", "url", "depth", F.lit("blocked").alias("outcome"))
    outcomes = asked.select("domain", "url", "depth", "outcome").unionByName(blocked).unionByName(lost)
    recorded = store.materialise(frontier.record(known, asked.withColumn("ts_ns", now_ns), compat), "recorded")
    dying = recorded.where("dead").join(asked.where("outcome IN ('error', 'nxdomain')").select("domain"), "domain", "left_semi")
    rest = queue.drop(mine.join(taken.select("domain", "seq"), ["domain", "seq"], "left_anti"), dying)
    again = asked.where("outcome = 'rate_limited'").select("domain", "url", "depth")
    tail = mine.groupBy("domain").agg((F.max("seq") + 1).alias("seq"))
    left = store.materialise(rest.unionByName(again.join(tail, "domain").select(*rest.columns)), "left")
    back = frontier.rebuild(left.join(outcomes.where("outcome <> 'dead'").select("domain"), "domain", "left_semi"), recorded, now_ns)
    return Fetched(
        outcomes,
        asked.where("outcome = 'ok'").select("domain", "url", "depth", "body"),
        others(queued).unionByName(left),
        others(state).unionByName(recorded),
        frontier.push(others(front).select("domain", "next_fetch"), back.withColumnRenamed("next_fetch_ns", "next_fetch")),
    )
