import pytest
from pyspark.sql import functions as F

from crawlframe.functions import hashing, html, http, politeness, robots, sitemap, urls

# What must come out is fixed by the crawler's rules; the URLs are our own.
NORMAL = [
    ("HTTPS://Shop.Test/Cart", "https://shop.test/Cart"),
    ("http://shop.test:80/a", "http://shop.test/a"),
    ("https://shop.test:443/a", "https://shop.test/a"),
    ("http://shop.test:443/a", "http://shop.test:443/a"),
    ("https://shop.test:9443/a", "https://shop.test:9443/a"),
    ("https://www.shop.test/a", "https://shop.test/a"),
    ("https://shop.test/a#reviews", "https://shop.test/a"),
    ("https://shop.test", "https://shop.test/"),
    ("https://shop.test/a///", "https://shop.test/a"),
    ("https://shop.test//x////y/z", "https://shop.test/x/y/z"),
    ("https://shop.test/find?size=9&colour=red&colour=blue", "https://shop.test/find?colour=blue&colour=red&size=9"),
    ("https://shop.test/a?utm_campaign=may&sku=77&gclid=x", "https://shop.test/a?sku=77"),
    ("https://shop.test/a?MsClkId=1", "https://shop.test/a"),
    ("https://shop.test/a?empty=&sku=1", "https://shop.test/a?sku=1"),
    ("https://shop.test/a?k=&k=2", "https://shop.test/a?k=&k=2"),
    ("https://shop.test/a?q=two%20words&q=5*~", "https://shop.test/a?q=5%2A~&q=two+words"),
    ("https://shop.test/größe", "https://shop.test/gr%C3%B6%C3%9Fe"),
    ("https://old_name.test/x", "https://old_name.test/x"),
    ("gopher://shop.test/f", ""),
    ("data:text/plain,hi", ""),
    ("https://shop.test/%q1", ""),
    (None, ""),
]
RESOLVED = [
    ("https://example.com/a/b", "c", "https://example.com/a/c"),
    ("https://example.com/a/b", "/c", "https://example.com/c"),
    ("https://example.com/a/b/", "../d", "https://example.com/a/d"),
    ("https://example.com/a/b/c", "../../d", "https://example.com/d"),
    ("https://example.com/a/b", "./d?x=1", "https://example.com/a/d?x=1"),
    ("https://example.com/a", "//Other.com/x", "https://other.com/x"),
    ("https://example.com/a?q=1", "?p=2", "https://example.com/a?p=2"),
    ("https://example.com/a", " http://www.x.org ", "http://x.org/"),
    ("https://example.com/a", "#top", ""),
    ("https://example.com/a", "javascript:void(0)", ""),
    ("https://example.com/a", "mailto:a@b.c", ""),
    ("https://example.com/a", "tel:1", ""),
    ("https://example.com/a", "ftp://x/y", ""),
    ("https://example.com/a", "", ""),
    ("https://example.com/a", None, ""),
    ("https://example.com/a", "/" + "x" * 2100, ""),
]


def test_normalize(spark):
    df = spark.createDataFrame(NORMAL, "url string, want string")
    wrong = df.withColumn("got", urls.normalize_url(F.col("url"))).where("got IS DISTINCT FROM want")
    assert wrong.collect() == []


def test_normalize_is_idempotent(spark):
    once = urls.normalize_url(F.col("url"))
    df = spark.createDataFrame(NORMAL, "url string, want string").select(once.alias("url")).where("url <> ''")
    assert df.withColumn("again", urls.normalize_url(F.col("url"))).where("again <> url").collect() == []


def test_resolve(spark):
    df = spark.createDataFrame(RESOLVED, "base string, href string, want string")
    wrong = df.withColumn("got", urls.resolve_href(F.col("base"), F.col("href"))).where("got IS DISTINCT FROM want")
    assert wrong.collect() == []


def test_domain(spark):
    df = spark.createDataFrame([("https://WWW.Example.com:8080/x",), ("http://a@b.c/d",), ("https://[::1]:80/",)], "u string")
    assert [r[0] for r in df.select(urls.extract_domain(F.col("u"))).collect()] == ["example.com", "b.c", "::1"]


def test_fnv(spark):
    df = spark.createDataFrame([("a",), ("example.com",), ("",)], "s string")
    got = [r[0] for r in df.select(hashing.fnv1a64_hex(F.col("s"))).collect()]
    assert got == ["af63dc4c8601ec8c", "576846634e2714c6", "cbf29ce484222325"]


PAGE = """<a href="/1">x</a><A class='k' HREF='/2?a=1&amp;b=2'>y</A><a/href=/3><!-- <a href="/no"> -->
<script>"<a href='/no2'>"</script><abbr href="/no3"><a name=z><link href="/no4"><a href="/4" href="/5">"""


def test_hrefs(spark):
    got = spark.range(1).select(html.hrefs(F.lit(PAGE))).first()[0]
    assert got == ["/1", "/2?a=1&b=2", "/3", "/4", "/5"] == [r["href"] for r in html.ExactLinks(F.lit(PAGE)).collect()]
    tricky = """<a title="x href=/no"href='/6' data-href=/no2><a href = /7/ ><a\nhref="a&#38;b"/><a href>"""
    assert spark.range(1).select(html.hrefs(F.lit(tricky))).first()[0] == ["/6", "/7/", "a&b"]


@pytest.mark.parametrize(
    ("path", "pattern", "want"),
    [
        ("/a/b", "/a", True), ("/b", "/a", False), ("/x.php", "/*.php$", True), ("/a.php.php", "/*.php$", False),
        ("/abc", "/a*$", False), ("/a", "/a$", True), ("/ab", "/a$", False), ("/x/private/y", "*/private/", True), ("/q", "*", True),
    ],
)
def test_robots_pattern(spark, path, pattern, want):
    assert spark.range(1).select(robots.matches(F.lit(path), F.lit(pattern))).first()[0] is want


def test_robots_choice(spark):
    body = F.lit("User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow: /p\nAllow: /p/q\nSitemap: https://x/s\n")
    for agent, path, want in (("bot/1", "/p/q/r", True), ("bot/1", "/p/x", False), ("other", "/z", False)):
        group = robots.chosen_group(robots.groups(body), agent)
        assert spark.range(1).select(robots.allowed(F.lit(path), group["rules"])).first()[0] is want
    assert spark.range(1).select(robots.sitemaps(body)).first()[0] == ["https://x/s"]


def test_sitemap(spark):
    body = "<urlset><url><loc>https://a/1</loc></url><URL><LOC><![CDATA[https://a/2]]></LOC></URL><url><x/></url><url><loc>https://a/3</loc></url>"
    assert spark.range(1).select(sitemap.locs(F.lit(body), "url")).first()[0] == ["https://a/1", "https://a/2"]
    many = "".join(f"<url><loc>https://a/{k}</loc></url>" for k in range(1100))
    assert len(spark.range(1).select(sitemap.locs(F.lit(many), "url")).first()[0]) == 1000


def test_http(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cases = {"120": 120, "0": 0, "-5": 0, "99999": 3600, "Mon, 01 Jan 2024 00:01:00 GMT": 60, "Sun, 31 Dec 2023 00:00:00 GMT": 0, "x": 0, "": 0}
    df = spark.createDataFrame([*cases.items()], "v string, want bigint")
    assert df.where(http.retry_after_seconds(F.col("v"), now) != F.col("want")).collect() == []
    wires = {"3\thttps://x": ("https://x", 3), "https://x": ("https://x", 0), "\thttps://x": ("\thttps://x", 0), "a\tb": ("a\tb", 0)}
    for wire, want in wires.items():
        assert tuple(spark.range(1).select(http.decode_wire(F.lit(wire))).first()[0]) == want
    assert spark.range(1).select(http.tls_version_name(F.lit(0x0304))).first()[0] == "TLS 1.3"


def test_politeness(spark):
    ms = 1_000_000
    got = spark.range(1).select(
        politeness.ema(F.lit(200 * ms), F.lit(600 * ms)), politeness.adaptive_delay(F.lit(10 * ms), F.lit(None).cast("bigint")),
        politeness.adaptive_delay(F.lit(10_000 * ms), F.lit(40 * politeness.SECOND)), politeness.error_backoff(F.lit(5)), politeness.error_backoff(F.lit(6)),
    ).first()
    assert tuple(got) == (320 * ms, politeness.MIN_DELAY, 40 * politeness.SECOND, 60 * politeness.SECOND, 120 * politeness.SECOND)
