"""Gradients against two loops over pairs; trees against pointwise ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import evaluation, lambdamart, ranking

FEATURED = "query_id long, chunk_id long, label double, score double, rank int, " + ", ".join(f"{f} double" for f in ranking.FEATURES)


def pair_sums(rows, k):
    """rows of one query: (chunk_id, label, score)."""
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    place = {r[0]: 1 / math.log2(i + 2) if i < k else 0.0 for i, r in enumerate(order)}
    ideal = sum(label / math.log2(i + 2) for i, label in enumerate(sorted((r[1] for r in rows), reverse=True)[:k]))
    out = {r[0]: [0.0, 0.0] for r in rows}
    for a, la, sa in rows:
        for b, lb, sb in rows:
            if la > lb and ideal:
                rho = 1 / (1 + math.exp(sa - sb))
                change = abs((la - lb) * (place[a] - place[b])) / ideal
                for who, sign in ((a, 1), (b, -1)):
                    out[who][0] += sign * rho * change
                    out[who][1] += rho * (1 - rho) * change
    return out


def test_lambdas_by_hand(spark):
    rng = np.random.default_rng(0)
    rows = [(q, c, float(rng.integers(0, 3)) if q else 0.0, round(float(rng.normal()), 1)) for q in range(6) for c in range(1, 3 + 4 * q)]
    table = lambdamart.with_ideal(spark.createDataFrame(rows, "query_id long, chunk_id long, label double, score double"), "label", 5)
    got = {(r.query_id, r.chunk_id): (r.gradient, r.curvature) for r in lambdamart.lambdas(table, k=5).collect()}
    for q in range(6):
        for chunk, want in pair_sums([r[1:] for r in rows if r[0] == q], 5).items():
            assert got[q, chunk] == pytest.approx(want, abs=1e-12)
    assert len(got) == len(rows)


def level_data(seed, queries=60):
    """The relevant candidate is the highest of its query; queries lie at levels of their own, and those at
    high levels have more irrelevant candidates, so that a high value alone speaks against relevance."""
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(queries):
        level = rng.uniform(0, 0.8)
        n = 3 + int(level * 25)
        values = level + rng.uniform(0, 0.12, n)
        for c, value in enumerate(values):
            others = rng.uniform(0, 1, len(ranking.FEATURES) - 1)
            rows.append((q, c, float(value == values.max()), float(-c), c + 1, float(value), *map(float, others)))
    return rows


def ndcg(spark, reranker, rows):
    table = spark.createDataFrame(rows, FEATURED)
    run = reranker.rerank(table, 1000).select("query_id", F.col("chunk_id").alias("doc_id"), "score")
    qrels = table.filter("label > 0").select("query_id", F.col("chunk_id").alias("doc_id"), F.col("label").cast("int").alias("rel"))
    return evaluation.evaluate(run, qrels).first().ndcg_at_10


def test_listwise_is_no_worse_than_pointwise_on_other_queries(spark):
    train, held_out = spark.createDataFrame(level_data(1), FEATURED), level_data(2)
    listwise = lambdamart.ListwiseReranker().train(train, trees=8, depth=3)
    pointwise = ranking.TreeReranker().train(train, trees=8, depth=3)
    ours, theirs = ndcg(spark, listwise, held_out), ndcg(spark, pointwise, held_out)
    assert ours > theirs, (ours, theirs)


def test_degenerate_tables(spark):
    rows = [(1, c, 0.0, 0.0, c + 1, *([0.5] * len(ranking.FEATURES))) for c in range(5)]
    table = spark.createDataFrame(rows, FEATURED)
    with pytest.raises(RuntimeError, match="not trained"):
        lambdamart.ListwiseReranker().rerank(table, 10)
    same = lambdamart.ListwiseReranker().train(table, trees=2)  # nothing is relevant
    assert [r.chunk_id for r in same.rerank(table, 10).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    labelled = table.withColumn("label", F.when(F.col("chunk_id") == 4, 1.0))  # null labels; features without two values
    assert lambdamart.ListwiseReranker().train(labelled, trees=2).rerank(table, 10).count() == 5
    assert lambdamart.ListwiseReranker().train(table.limit(0), trees=1).trees == [0.0]
