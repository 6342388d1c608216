"""Every alert rule fires where it should, when it should, and nowhere else."""

import dataclasses
import datetime as dt

import pytest

from crawlframe.operators import alerts

START = 1_700_000_040  # a multiple of 60
SCHEMA = "metric string, job string, instance string, series string, le double, ts timestamp, value double"
STEP, LENGTH = 60, 2_400


def _row(metric, job, t, value, le=None, instance="a"):
    return metric, job, instance, "", le, dt.datetime.fromtimestamp(START + t, dt.timezone.utc), float(value)


def _samples(bad):
    rows = []
    for t in range(0, LENGTH, STEP):
        k = t // STEP

        def add(metric, good, ill, job="crawler", le=None, t=t):
            rows.append(_row(metric, job, t, ill if bad else good, le))

        add("pages_fetched_total", 100 * k, 100 * k)
        add("fetch_errors_total", 10 * k, 30 * k)
        add("frontier_size", 5, 0)
        add("dedup_bloom_false_positives_total", k, 40 * k)
        add("dedup_bloom_hits_total", 100 * k, 100 * k)
        for metric, job, limit in (("fetch", "crawler", 5), ("tls", "crawler", 2), ("coredns_dns_request", "coredns", 1)):
            add(f"{metric}_duration_seconds_bucket", 100 * k, 10 * k, job, float(limit))
            add(f"{metric}_duration_seconds_bucket", 100 * k, 100 * k, job, 60.0)
            add(f"{metric}_duration_seconds_bucket", 100 * k, 100 * k, job, float("inf"))
        add("warc_write_errors_total", 7, k)
        add("inbox_forward_errors_total", 7, k)
        add("inbox_queue_size", 100_000, 100_001)
        add("up", 1, 0)
        add("up", 1, 0, "coredns")
        add("process_resident_memory_bytes", 3.5e9, 3.6e9)
        add("go_goroutines", 10_000, 10_001)
        add("process_open_fds", 80, 81)
        add("process_max_fds", 100, 100)
        add("coredns_cache_hits_total", 60 * k, 40 * k, "coredns")
        add("coredns_cache_misses_total", 40 * k, 60 * k, "coredns")
    return rows


def test_all_rules_fire_on_ill_samples_and_none_on_good(spark):
    rules = alerts.rules()
    assert len(rules) == len({r.name for r in rules}) == 17
    good = alerts.evaluate(spark.createDataFrame(_samples(False), SCHEMA), rules)
    assert good.count() == 0
    ill = alerts.evaluate(spark.createDataFrame(_samples(True), SCHEMA), rules).where("firing").select("alert").distinct()
    # pages still come, so that the crawl isn't stalled
    assert {r[0] for r in ill.collect()} == {r.name for r in rules} - {"CrawlStalled"}


def test_firing_begins_once_it_has_held_and_a_gap_starts_anew(spark):
    rule = next(r for r in alerts.rules() if r.name == "HighMemory")
    # one sample at 0, then none, so that the lookback of 300 s ends; then one a minute
    rows = [_row(rule.metric, "crawler", t, 4e9) for t in (0, *range(600, 1_200, 60))] + [_row(rule.metric, "other", 0, 9e9)]
    found = alerts.evaluate(spark.createDataFrame(rows, SCHEMA), [rule]).collect()
    held = {r["tick"] - START: r["firing"] for r in found}
    first, second = [t for t in held if t <= 300], [t for t in held if t > 300]
    assert sorted(first) == list(range(60, 301, 60)) and not any(held[t] for t in first)
    assert sorted(second) == list(range(660, 1_441, 60)) and [t for t in sorted(second) if held[t]] == list(range(960, 1_441, 60))


def test_stalled_needs_samples(spark):
    rule = next(r for r in alerts.rules() if r.name == "CrawlStalled")
    flat = [_row(rule.metric, "crawler", t, 50) for t in range(0, LENGTH, STEP)]
    assert alerts.evaluate(spark.createDataFrame(flat, SCHEMA), [rule]).where("firing").count() > 0
    assert alerts.evaluate(spark.createDataFrame(flat[:1], SCHEMA), [rule]).count() == 0
    assert alerts.evaluate(spark.createDataFrame([], SCHEMA), alerts.rules()).count() == 0


def test_reset_and_division_by_zero(spark):
    rule = next(r for r in alerts.rules() if r.name == "HighFetchErrorRate")
    rows = [_row(rule.other, "crawler", t, 9) for t in (0, 60)]
    rows += [_row(rule.metric, "crawler", 0, 9), _row(rule.metric, "crawler", 60, 3)]
    found = alerts.values(spark.createDataFrame(rows, SCHEMA), rule)
    assert {r["value"] for r in found.collect()} == {float("inf")}
    still = [(*r[:6], 9.0) for r in rows]
    assert alerts.values(spark.createDataFrame(still, SCHEMA), rule).count() == 0
    errors = alerts.values(spark.createDataFrame(rows, SCHEMA), dataclasses.replace(rule, kind="rate"))
    assert {r["value"] for r in errors.collect()} == {3 / 300}


def test_prefix_step_and_kind(spark):
    named = {r.metric for r in alerts.rules("x_")}
    assert "x_frontier_size" in named and "up" in named
    samples = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        alerts.evaluate(samples, alerts.rules(), step=7)
    with pytest.raises(ValueError):
        alerts.values(samples, dataclasses.replace(alerts.rules()[0], kind="no"))
