"""Sources, sinks, state and streams of the crawl loops."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from crawlframe.functions import html, politeness
from crawlframe.operators import dedup, frontier, inbox, queue, store
from crawlframe.plans import crawl
from crawlframe.sources import archive, tables
from crawlframe.streaming import state

REPO = Path(__file__).parent.parent
EVENTS = "event_id bigint, ts_ns bigint, domain string, outcome string, latency_ns bigint, robots_delay_ns bigint, retry_after_ns bigint"


def test_the_rest_works_without_the_llm_folders(tmp_path):
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=kept)
    said = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'crawl_round' in o and 'pipeline' not in q; print(len(q))"
    for folder in (tmp_path / "repo",):
        for gone in ((), ("corpus_pipeline.py",)):
            for name in gone:
                (folder / name).unlink()
            done = subprocess.run([sys.executable, "-c", said], cwd=folder, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
            assert done.returncode == 0 and int(done.stdout) > 50, done.stderr


def test_attempts():
    waited = []
    got = {u: tables.attempt(fakes_fetch, f"https://a/{u}", waited.append)[1:] for u in ("ok", "flaky", "gone", "down", "limit", "image", "lost", "big")}
    assert got["ok"] == (200, "text/html", b"ok", None, 1) and got["lost"] == (404, "text/html", b"not here", None, 1)
    assert got["flaky"][2:] == (b"late", None, 2) and got["down"][2:] == (None, "conn_reset", 2)
    assert got["gone"][3:] == ("dns_nxdomain", 1) and got["limit"][2:] == (None, "rate_limited", 1) and got["image"][2:] == (None, "not_retryable", 1)
    assert len(got["big"][2]) == tables.BODY_BYTES and waited == [0.5, 0.5]


def fakes_fetch(url):
    from tests import fakes

    return fakes.fetch(url)


def test_fetch_source_and_table(spark, tmp_path):
    names = ["ok", "gone", "limit", "lost"]
    (tmp_path / "urls.txt").write_text("".join(f"https://b/{n}\n" for n in names) + "\n")
    spark.dataSource.register(tables.FetchSource)
    read = spark.read.format("crawl_fetch").option("fetcher", "tests.fakes:fetch").option("partitions", "3")
    want = {("https://b/ok", None), ("https://b/gone", "dns_nxdomain"), ("https://b/limit", "rate_limited"), ("https://b/lost", None)}
    for rows in (read.option("path", f"{tmp_path}/urls.txt").load(), read.option("urls", "\n".join(f"https://b/{n}" for n in names)).load()):
        assert {(r["url"], r["error"]) for r in rows.collect()} == want
    asked = spark.createDataFrame([(f"https://b/{n}",) for n in names] + [(None,)], "url string")
    assert {(r["url"], r["error"]) for r in tables.fetch_pages(asked, "tests.fakes:fetch", 2).collect()} == want


def test_archive_commits_whole_tasks(tmp_path):
    from pyspark.sql import Row

    writer = archive._WarcWriter({"path": str(tmp_path), "max_bytes": "700"})
    rows = [Row(url=f"https://x/{k}", date="2024-01-01T00:00:00Z", body=b"answer", request=b"GET" if k % 2 else None) for k in range(6)]
    lost, kept, undone = (writer.write(iter(rows)) for _ in range(3))
    assert not list(tmp_path.glob("[!.]*")) and len(kept.files) > 1
    writer.commit([kept])
    writer.abort([undone, None])
    assert sorted(p.name for p in tmp_path.glob("[!.]*")) == sorted(kept.files)
    assert {p.name for p in tmp_path.glob(".*")} == {f".{n}" for n in lost.files}


def test_forwarding_leaves_out_own_rows(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (-1, "d")], "owner int, url string")
    archive.forward(rows, f"{tmp_path}/out", me=1)
    assert {r["url"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "c"}


def test_seeds_of_one_node(spark, tmp_path):
    (tmp_path / "s.txt").write_text("".join(f"d{k}.com\n" for k in range(60)))
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node_id"))
    parts = [{r["url"] for r in tables.seeds(spark, f"{tmp_path}/s.txt", nodes, k).collect()} for k in range(3)]
    assert all(parts) and sum(map(len, parts)) == len(set.union(*parts)) == 60


def events(n, rng, kinds, domains=7):
    return [(k, k * 10**9, f"d{rng.randrange(domains)}", rng.choice(kinds), rng.choice([None, rng.randint(1, 10**10)]), rng.choice([None, 3 * 10**9]), rng.choice([None, 0, 9 * 10**10])) for k in range(n)]


def test_one_step_equals_the_fold(spark):
    rng = random.Random(7)
    for compat in (False, True):
        rows = events(40, rng, ["ok", "error", "error", "error", "rate_limited", "nxdomain"], 12)
        log = spark.createDataFrame(rows, EVENTS)
        want = {r["domain"]: r for r in frontier.fold(log, compat).collect()}
        got = spark.createDataFrame([], frontier.STATE)
        turns = max(sum(r[2] == d for r in rows) for d in want)
        nth = {}
        by_turn = [[] for _ in range(turns)]
        for r in rows:
            by_turn[nth.setdefault(r[2], 0)].append(r)
            nth[r[2]] += 1
        for turn in by_turn:
            after = frontier.record(got, spark.createDataFrame(turn, EVENTS), compat)
            got = spark.createDataFrame(after.collect(), frontier.STATE)
        assert {r["domain"]: r for r in got.collect()} == want


def test_rate_limits_and_the_tenth_error():
    s = politeness.FRESH
    assert politeness.advance(s, "rate_limited", 0, None, None, 7 * 10**9)[4] == 7 * 10**9
    assert politeness.advance(s, "rate_limited", 0, None, None, 0)[4] == 2 * 10**9 == politeness.advance(s, "rate_limited", 0, None, None)[1]
    for k in range(1, 11):
        s = politeness.advance(s, "error", k * 10**9, None, None)
    assert s[0] and s[4] == (9 + 16 * 60) * 10**9 and s[5] == 10  # of the ninth
    assert politeness.advance(politeness.FRESH, "nxdomain", 5, None, None) == (True, *politeness.FRESH[1:])


def test_state_bytes(spark):
    row = spark.range(1).select(F.struct(F.lit(True).alias("dead"), F.lit(True).alias("sitemap_checked"), F.lit(0).alias("crawl_delay_ns"), F.lit(-5).alias("robots_delay_ns"),
        F.lit(1 << 40).alias("avg_latency_ns"), F.lit(None).cast("bigint").alias("last_fetch_ns"), F.lit(77).alias("backoff_until_ns"), F.lit(-1).alias("consecutive_errors")).alias("s"))
    data = row.select(politeness.encode_state(F.col("s")).alias("d"))
    back = data.select(F.octet_length("d"), politeness.decode_state(F.col("d")), politeness.decode_state(F.concat(F.unhex(F.lit("02")), F.substring("d", 2, 45)))).first()
    assert back[0] == politeness.STATE_BYTES and back[2] is None
    assert tuple(back[1]) == (True, True, politeness.DEFAULT_DELAY, -5, 1 << 40, None, 77, -1)


def test_global_cap_equals_a_sorted_limit(spark, monkeypatch):
    monkeypatch.setattr(queue, "CUT_ROWS", 5)
    monkeypatch.setattr(queue, "CUT_BUCKETS", 4)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(-50, 50)]), k) for k in range(300)]
    items = spark.createDataFrame(rows, "at bigint, id bigint")
    for cap in (0, 1, 7, 150, 299, 300, 1000):
        got = queue.global_cap(items, 3, "at", "id", cap=cap + 3).collect()
        assert sorted(map(str, got)) == sorted(map(str, items.orderBy("at", "id").limit(cap).collect()))
    assert queue.global_cap(items.limit(0), 0, "at").count() == 0


def test_bloom_places_and_pages(spark):
    keys = [f"key-{k}é" for k in range(200)] + ["", "x"]
    df = spark.createDataFrame([(k,) for k in keys], "url string")
    plain = dedup.Bloom(200, 0.01)
    got = {r["url"]: r["p"] for r in df.select("url", dedup.bloom_places(F.col("url"), 200).alias("p")).collect()}
    assert all(got[k] == plain.places(k) for k in keys)
    probes = spark.createDataFrame([(f"probe-{k}",) for k in range(500)] + [(None,)], "url string")
    bloom = dedup.build_bloom(df, "url", 200)
    for k in keys:
        plain.add(k)
    tested = {r["url"]: r["maybe"] for r in dedup.test_bloom(probes.unionByName(df), "url", bloom, 200).collect()}
    assert all(tested[k] for k in keys) and all(tested[f"probe-{k}"] == plain.test(f"probe-{k}") for k in range(500)) and tested[None] == plain.test("")
    _, more = dedup.test_and_add(probes, "url", bloom, 200)
    assert dedup.test_bloom(probes, "url", more, 200).where("NOT maybe").count() == 0
    assert dedup.test_bloom(probes, "url", bloom.limit(0), 200).where("maybe").count() == 0


def test_soft404_stream(spark, tmp_path):
    schema = "id bigint, domain string, html string"
    for name, rows in (("1", [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x")]), ("2", [(5, "a", "x"), (6, "b", "x"), (7, "b", "x")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = state.soft404(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "id")
        query = stream.writeStream.trigger(once=True).format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        assert query.awaitTermination(60)  # processing-time timeouts keep any other trigger busy
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4, 6]


def test_inbox_batches(spark):
    wires = spark.createDataFrame([(k, f"{k % 3}\thttps://h{k % 4}.com/{k // 2}") for k in range(20)] + [(20, "no tab"), (21, "30\thttps://deep.com/")], "arrival bigint, value string")
    seen = spark.createDataFrame([("https://h1.com/8",)], "url string")
    queued = spark.createDataFrame([], "domain string, seq bigint, url string, depth int")
    got = inbox.receive(wires, seen, queued, 8)
    assert got.rest.count() == 14 and {r["url"] for r in got.items.where("domain LIKE 'h%'").collect()} == {"https://h3.com/9", "https://h2.com/9", "https://h0.com/8", "https://h3.com/7", "https://h2.com/7"}
    assert got.items.where("domain = 'deep.com'").count() == 0 and got.new.where("url = 'https://deep.com/'").count() == 1


def test_references(spark):
    cases = {"&#65;&#x1F600;&amp;lt;&#0;": "A\U0001f600&lt;\ufffd", "a&b;&nbsp;&#xD800;": "a&b;\u00a0\ufffd", "": "", "plain": "plain", "&#9999999;": "\ufffd"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("got", html.unescape(F.col("t"))).collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_all_entries_of_an_index_are_followed(spark):
    """An index whose first 1,200 sitemaps can't be had still gives the URLs of those after."""
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a/{k}</loc></sitemap>" for k in range(1300)) + "</sitemapindex>"
    leaves = [(f"https://a/{k}", f"<urlset><url><loc>https://a/p{k}</loc></url></urlset>") for k in range(1200, 1300)]
    roots = spark.createDataFrame([("a", 0, "https://a/sitemap.xml")], "domain string, pos int, url string")
    got = crawl.sitemap_urls(roots, spark.createDataFrame([("https://a/sitemap.xml", index), *leaves], "url string, body string")).collect()
    assert sorted((r["pos"], r["url"]) for r in got) == [(k - 1199, f"https://a/p{k}") for k in range(1200, 1300)]


def test_a_round_folds_the_log_once(spark, monkeypatch):
    """The politeness fold and the queues are worked out once for fetch_round, however often they are used."""
    from crawlframe import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, keep = [], store.materialise
    monkeypatch.setattr(store, "materialise", lambda df, name: plans.append((name, plan(df))) or keep(df, name))
    result = queries.fetch_round(spark, "/root/testdata/sf0.001")
    plans.append(("result", plan(result)))
    assert {n: p.count("MapInArrow") for n, p in plans if "MapInArrow" in p} == {"state": 1}
    assert {n for n, p in plans if "events.parquet" in p} == {"queue", "state", "asked"}
    assert dict(plans)["state"].count("events.parquet") == 1


def test_a_round_leaves_other_domains_as_they_are(spark):
    domains = [f"d{k}" for k in range(6)]
    queued = [(d, n, f"https://{d}/{n}", 1) for d in domains[:5] for n in range(2)]
    front = spark.createDataFrame([(d, k) for k, d in enumerate(domains)] + [(None, 99)], "domain string, next_fetch bigint")
    state = spark.createDataFrame([("d1", True, 1, 1, 1, None, 0), ("d4", False, 7, 7, 7, None, 3), ("d9", False, 5, 5, 5, None, 2)], frontier.STATE)
    bodies = spark.createDataFrame([(d, "User-agent: *\nDisallow: /") for d in ("d2", "d4")], "domain string, body string")
    answers = [("https://d0/0", "ok", 10, None, "page"), ("https://d3/0", "rate_limited", 10, None, ""), ("https://d4/0", "nxdomain", 10, None, "")]
    responses = spark.createDataFrame(answers, "url string, outcome string, latency_ns bigint, retry_after_ns bigint, body string")
    items = spark.createDataFrame(queued, "domain string, seq bigint, url string, depth int")
    after = crawl.fetch_round(front, items, state, bodies, responses, "bot", F.lit(50), 4)
    assert {(r["domain"], r["outcome"]) for r in after.outcomes.collect()} == {("d0", "ok"), ("d1", "dead"), ("d2", "blocked"), ("d3", "rate_limited")}
    assert [(r["url"], r["body"]) for r in after.pages.collect()] == [("https://d0/0", "page")]
    left = {(r["domain"], r["seq"], r["url"]) for r in after.queue.collect()}
    assert left == {(d, 1, f"https://{d}/1") for d in domains[:4]} | {("d3", 2, "https://d3/0"), ("d4", 0, "https://d4/0"), ("d4", 1, "https://d4/1")}
    states = {r["domain"]: r for r in after.state.collect()}
    assert set(states) == {"d0", "d1", "d3", "d4", "d9"} and states["d4"]["consecutive_errors"] == 3 and states["d9"]["crawl_delay_ns"] == 5
    assert states["d0"]["last_fetch_ns"] == 50 and states["d3"]["crawl_delay_ns"] == 2 * politeness.DEFAULT_DELAY
    times = {r["domain"]: r["next_fetch"] for r in after.frontier.collect()}
    assert set(times) == {"d0", "d2", "d3", "d4", "d5", None} and times["d4"] == 4 and times["d2"] == 50
