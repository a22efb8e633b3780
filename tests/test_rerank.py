from pyspark.sql import functions as F

from lodeseek.operators import ranking
from lodeseek.plans.catalog import CATALOG


def test_a_fit_reads_its_candidates_from_memory(spark, monkeypatch):
    """Every step of the fit reads them, and making them takes passes over the corpus."""
    seen = []

    def train(self, featured, **_):
        seen.append(featured.storageLevel.useMemory)
        return self

    monkeypatch.setattr(ranking.TreeReranker, "train", train)
    monkeypatch.setattr(ranking.TreeReranker, "rerank", lambda self, featured, top_n: featured.withColumn("rank", F.lit(1)))
    CATALOG["gbt_rerank"](spark, "/root/testdata/sf0.001")
    assert seen == [True]
