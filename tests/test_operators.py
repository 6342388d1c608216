import gzip
import os

from pyspark.sql import functions as F

from crawlframe.operators import dedup, frontier, metrics, queue, ring
from crawlframe.sources import archive, tables
from crawlframe.streaming import state


def test_bloom():
    bloom = dedup.Bloom(1000, 0.01)
    for k in range(1000):
        bloom.add(f"insert-{k}")
    assert all(bloom.test(f"insert-{k}") for k in range(1000))
    assert sum(bloom.test(f"probe-{k}") for k in range(1000)) <= 50
    assert not bloom.test_and_add("fresh") and bloom.test("fresh")
    m, k = dedup.size_of(100_000_000, 0.01)
    assert 100e6 < m / 8 < 140e6 and k == 7


def test_ring(spark):
    domains = spark.range(500).select(F.concat(F.lit("d"), "id", F.lit(".com")).alias("domain"))
    nodes = lambda n: spark.range(n).select(F.col("id").cast("int").alias("node_id"))
    three = {r["domain"]: r["owner"] for r in ring.with_owner(domains, F.col("domain"), nodes(3)).collect()}
    four = {r["domain"]: r["owner"] for r in ring.with_owner(domains, F.col("domain"), nodes(4)).collect()}
    assert len(three) == 500 and set(three.values()) == {0, 1, 2}
    assert all(four[d] in (three[d], 3) for d in three)  # only to the new node
    assert {r["owner"] for r in ring.with_owner(domains, F.col("domain"), nodes(0)).collect()} == {-1}


def test_fold_equals_streaming_step(spark):
    import random

    rng = random.Random(3)
    kinds = ["ok"] * 4 + ["error"] * 5 + ["rate_limited", "nxdomain"]
    rows = [(k, k * 10**9, f"d{k % 7}", rng.choice(kinds), rng.randint(1, 10**10), None) for k in range(400)]
    schema = "event_id bigint, ts_ns bigint, domain string, outcome string, latency_ns bigint, robots_delay_ns bigint"
    got = {r[0]: tuple(r[1:]) for r in frontier.fold(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for _, ts, domain, outcome, latency, robots in rows:
        want[domain] = state.step(want.get(domain, (False, 10**9, 0, None, None, 0)), outcome, ts, latency, robots)
    assert got == want
    compat = frontier.fold(spark.createDataFrame(rows, schema), compat=True).collect()
    assert all(r["consecutive_errors"] <= 1 for r in compat)


def test_streaming_state_and_inbox(spark, tmp_path):
    schema = "event_id bigint, ts_ns bigint, domain string, outcome string, latency_ns bigint, robots_delay_ns bigint"
    rows = [(k, k * 10**9, "a", "error", 1, None) for k in range(6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/log")
    query = state.politeness(spark.readStream.schema(schema).parquet(f"{tmp_path}/log")).writeStream.outputMode("update").format("memory").queryName("polite").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT max(consecutive_errors) FROM polite").first()[0] == 6
    os.makedirs(f"{tmp_path}/wire")
    with open(f"{tmp_path}/wire/1.txt", "w") as f:
        f.write("3\thttps://x.com/a\nhttps://x.com/b\n3\thttps://x.com/a\n")
    query = state.inbox(spark.readStream.text(f"{tmp_path}/wire")).writeStream.format("memory").queryName("inbox").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("inbox").collect())) == [("https://x.com/a", "x.com", 3), ("https://x.com/b", "x.com", 0)]


def test_rounds_write_each_batch_once(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a restart finds nothing new
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
        query = state.rounds(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_queue_and_frontier(spark):
    items = spark.createDataFrame([("a", f"https://a/{k}", 1, k) for k in range(7)] + [("b", "x" * 3000, 1, 8), ("b", "y", 26, 9)], "domain string, url string, depth int, at int")
    queued = queue.enqueue(queue.admit(items), "at", domain_cap=5)
    assert [tuple(r) for r in queue.lengths(queued).collect()] == [("a", 5)]
    head, rest = queue.dequeue(queued)
    assert head.first()["seq"] == 0 and rest.count() == 4
    first = spark.createDataFrame([("a", 5), ("b", 3)], "domain string, next_fetch bigint")
    pushed = frontier.push(first, spark.createDataFrame([("a", 2), ("b", 9)], first.schema))
    assert [tuple(r) for r in frontier.pop_ready(pushed, F.lit(3), 5).collect()] == [("a", 2), ("b", 3)]
    assert frontier.remove(pushed, first.where("domain = 'a'")).first()["domain"] == "b"
    tick = lambda fill, n, low: tuple(spark.range(1).select(frontier.worker_change(F.lit(fill), F.lit(n), 1, 8, F.lit(low))).first()[0])
    assert (tick(90, 2, 0), tick(60, 2, 0), tick(5, 2, 5), tick(5, 2, 1), tick(5, 1, 3)) == ((4, 0), (1, 0), (-1, 0), (0, 2), (0, 0))


def test_quantile_in_the_last_bucket(spark):
    rows = spark.createDataFrame([(100.0,)] * 5, "v double")
    assert metrics.histogram_quantile(metrics.histogram(rows, "v", metrics.DURATION), 0.95).first()["value"] == 60.0


def test_sources_and_sinks(spark, tmp_path):
    with open(f"{tmp_path}/seeds.txt", "w") as f:
        f.write("# c\n\n example.com \nb.org\n")
    assert sorted(r["url"] for r in tables.seeds(spark, f"{tmp_path}/seeds.txt").collect()) == ["https://b.org/", "https://example.com/"]
    got = spark.createDataFrame([("u1", 200, "text/html", b"x", 0), ("u2", 429, "text/html", b"x", 0), ("u3", 404, "text/html", b"y", 6), ("u4", 500, "image/png", b"", 0)],
                                "url string, status int, content_type string, body binary, redirect_count int")
    assert [r["url"] for r in tables.fetched(got).collect()] == ["u1"]
    spark.dataSource.register(archive.WarcSink)
    rows = spark.createDataFrame([(f"https://x/{k}", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\n\r\nhi") for k in range(10)], "url string, date string, body binary")
    rows.coalesce(2).write.format("warc").option("path", f"{tmp_path}/warc").option("max_bytes", "600").mode("append").save()
    files = os.listdir(f"{tmp_path}/warc")
    text = b"".join(gzip.decompress(open(f"{tmp_path}/warc/{f}", "rb").read()) for f in files)
    assert len(files) > 2 and text.count(b"WARC/1.1") == 10
