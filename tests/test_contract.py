"""Driver contract and the DuckDB oracle at sf0.001 for every query that has one."""
import os

import pytest

import __spark_entry__ as E
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["product_id", "iso_week", "rank", "cluster_id", "size", "term_rank", "word", "count"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_no_query_named_after_forbidden_words():
    from themelens.plans import catalog
    for name in catalog.registry():     # the reference's own operators; op* and pipeline belong to llm
        assert "pipeline" not in name and not name.startswith("op")


FAST = ["top_theme_words", "scrub_pii", "term_counts", "name_themes", "describe_themes", "ground_quotes",
        "parse_theme_responses", "report_markdown", "report_lines", "email_teasers", "similar_pairs",
        "nearest_neighbours", "density_cluster", "dedup_reviews", "take_until_older", "keyword_fallback",
        "read_app_store_feed", "weekly_counts_stream", "backfill", "collect_clusters", "normalise_ideas", "extract_json",
        "kmeans_fallback", "embed_with", "embed_texts", "embed_texts_versioned", "upsert_runs", "append_reviews", "write_reports", "stream_reviews",
        "app_store_feed_rejects", "review_rejects", "response_rejects", "density_cluster_table", "theme_lint", "latest_summary"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r.get("match"), r
