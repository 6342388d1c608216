"""Sitemaps as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 2 * 1024 * 1024
MAX_URLS = 1000


def is_index(body: Column) -> Column:
    return F.substring(body, 1, 512).contains("<sitemapindex")


def locs(body: Column, tag: str, most: int | None = MAX_URLS) -> Column:
    """The loc of each block (tag: url or sitemap) up to the first block without one, at most so many; None: all.

    A block reaches from the next tag that starts with the name to its end tag;
    CDATA is unwrapped, references stay as they are.
    """
    blocks = F.regexp_extract_all(body, F.lit(f"(?is)<{tag}.*?</{tag}>"), F.lit(0))
    found = F.transform(blocks, lambda b: F.regexp_extract(b, r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>", 1))
    first_without = F.coalesce(F.array_position(found, F.lit("")), F.lit(0))
    upto = F.when(first_without > 0, F.slice(found, F.lit(1), F.greatest(first_without - 1, F.lit(0)).cast("int"))).otherwise(found)
    web = F.filter(upto, lambda u: u.startswith("http://") | u.startswith("https://")) if tag == "url" else upto
    return web if most is None else F.slice(web, 1, most)
