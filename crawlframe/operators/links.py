"""From pages to links: soft-404 filter, extraction, resolution, first-seen order within a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.functions.html import hrefs
from crawlframe.functions.urls import extract_domain, resolve_href

SOFT404 = 3


def soft404(rows: DataFrame, domain: str, body: str, order: str, threshold: int = SOFT404) -> DataFrame:
    """rows without the threshold-th and later copies of a body within a domain.

    A body's first copies are a bounded prefix by order, so that the window's
    group limit cuts hot bodies in each task before the shuffle.
    """
    nth = F.row_number().over(Window.partitionBy(domain, body).orderBy(order))
    return rows.withColumn("__nth", nth).where(F.col("__nth") < threshold).drop("__nth")


def extract(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """pages' rows with pos and href: one for each href of an a tag."""
    keep = [c for c in pages.columns if c != body]
    return pages.select(*keep, F.posexplode(hrefs(F.col(body))).alias("pos", "href"))


def resolve(links: DataFrame, url: str = "url") -> DataFrame:
    """links with link and link_domain; those that aren't to be followed go."""
    out = links.withColumn("link", resolve_href(F.col(url), F.col("href"))).where("link <> ''")
    return out.withColumn("link_domain", extract_domain(F.col("link")))


def first_seen(links: DataFrame, page: str) -> DataFrame:
    """(page, link, link_domain, pos): each link of a page once, at its first place."""
    return links.groupBy(page, "link").agg(F.min("pos").alias("pos"), F.first("link_domain").alias("link_domain"))
