"""What a task holds doesn't grow with the corpus: no query keeps a row for each pair of query and document."""

import pytest

from lodeseek.operators import blocks
from lodeseek.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"
QUERIES = [
    "dedup_identity",
    "dedup_rename",
    "duplicate_rate",
    "evaluation_means",
    "evaluation_per_query",
    "listwise_lambdas",
    "minmax_scores",
    "rrf_fusion",
]


@pytest.mark.parametrize("name", QUERIES)
def test_scores_of_pairs_are_not_summed_in_hash_tables(spark, name):
    """A common word makes as many pairs as documents times queries; a hash table of them was a task's memory."""
    plan = CATALOG[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    assert "sum(part" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", QUERIES)
def test_a_larger_batch_of_queries_is_not_summed_in_hash_tables_either(spark, monkeypatch, name):
    """More queries than one matrix takes are cut into several."""
    monkeypatch.setattr(blocks, "MOST_CELLS", 10_000)
    plan = CATALOG[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()
    assert "sum(part" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["evaluation_means", "evaluation_per_query"])
def test_words_of_texts_are_not_joined_with_keys(spark, name):
    """A row for each three words of a text, and a hash table of the pairs they make, were most of the work."""
    plan = CATALOG[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    spark.catalog.clearCache()
    assert "explode(transform" not in plan and "InMemoryRelation" not in plan
