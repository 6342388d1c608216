"""Each registered query against its SQL."""

import pytest

from crawlframe.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, check_sql, name):
    check_sql(spark, QUERIES[name], ORACLE[name])


def test_bloom_has_no_false_negatives(spark):
    row = QUERIES["bloom_fp_rate"](spark, "/root/testdata/sf0.001").first()
    assert row["missed"] == 0 and row["fp_rate"] <= 0.05


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_sitemaps_beyond_the_cap(spark, tmp_path):
    """A host with more pages than a crawl takes of a site, and page numbers that come more than once, so that one body has more as well."""
    rows = [(k % 1500, f"https://big.example.com/{k}") for k in range(3500)] + [(7, "http://small.example.com/a"), (8, "http://small.example.com/a")]
    spark.createDataFrame(rows, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["sitemap_locs"](spark, str(tmp_path)).collect()
    assert sorted((r["host"], r["url"]) for r in got) == sorted((u.split("/")[2], u) for _, u in rows)
