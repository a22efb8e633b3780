"""The inverted file: recall, pruning and edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.errors import IndexNotFoundError
from lodeseek.operators import dense, ivf


def table(spark, matrix):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(matrix)], "chunk_id long, vector array<float>").repartition(4)


def clustered(n, dim, clusters, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def recall(found, exact):
    want = {(r.query_id, r.chunk_id) for r in exact.collect()}
    return len(want & {(r.query_id, r.chunk_id) for r in found.collect()}) / len(want)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    vectors = table(spark, clustered(3000, 32, 40))
    index = ivf.build(vectors, str(tmp_path / "index"), cells=60)
    assert index.rows.sum() == 3000 and len(index.centroids) == 60
    asked = vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = dense.search(vectors, asked, 10)
    found = ivf.search(index, spark, asked, 10)
    assert recall(found, exact) >= 0.9
    assert index.share < 0.2
    scores = {(r.query_id, r.chunk_id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.chunk_id] - r.score) < 1e-6 for r in found.collect() if (r.query_id, r.chunk_id) in scores)
    whole = ivf.search(index, spark, asked, 10, probes=60)  # all cells: codes order the candidates, vectors decide
    assert recall(whole, exact) == 1.0


def test_cells_are_pruned_at_the_scan(spark, tmp_path, capsys):
    vectors = table(spark, clustered(1000, 16, 20))
    index = ivf.build(vectors, str(tmp_path / "index"), cells=20)
    one = vectors.filter("chunk_id = 7").select(F.col("chunk_id").alias("query_id"), "vector")
    found = ivf.search(index, spark, one, 3, probes=2)
    assert found.first().chunk_id == 7
    read = spark.read.parquet(f"{index.folder}/vectors").filter(F.col("cell").isin([1, 2]))
    assert len(read.inputFiles()) >= 1
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1][:60]
    assert "ReadSchema: struct<chunk_id:bigint,code:binary,scale:float>" in plan  # the scan of codes reads no vectors


def test_unstructured_vectors_of_the_tables(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    index = ivf.build(rows, str(tmp_path / "index"))
    asked = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    assert recall(ivf.search(index, spark, asked, 11), dense.search(rows, asked, 11)) >= 0.9


def test_edges(spark, tmp_path):
    vectors = table(spark, np.array([[1.0, 0.0]] * 5 + [[0.0, 0.0]]))
    index = ivf.build(vectors, str(tmp_path / "index"), cells=3)
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [r.chunk_id for r in ivf.search(index, spark, asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert ivf.search(index, spark, asked.limit(0), 3).count() == 0
    empty = ivf.build(vectors.limit(0), str(tmp_path / "empty"))
    assert ivf.search(empty, spark, asked, 3).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        ivf.search(index, spark, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>"), 3)
    with pytest.raises(IndexNotFoundError):
        ivf.load(spark, str(tmp_path / "nowhere"))
