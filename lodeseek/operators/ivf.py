"""An inverted file of vectors: cells of near vectors, stored apart, of which a search reads those near the query.

Cells are the centroids of spherical k-means, fitted by Spark on a bounded sample; every vector is then stored in the folder of
its cell, with its residual from the centroid in one byte a dimension.  A search multiplies queries with the codes of the
cells that they probe, and with nothing else: folders of other cells aren't read.  The best of these, a few times
k, are then compared by their stored vectors, so the scores are exact.  How many cells a query probes is measured when the
index is made, on vectors of it that ask for their own neighbours: the least number that reaches the wanted recall.

Unstructured vectors need many cells: no index of this kind can do without.  ``Cells.share`` tells the share of codes that a query reads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.errors import IndexNotFoundError, MissingEmbeddingsError
from lodeseek.operators import dense
from lodeseek.operators.lexical import top_k

#: Rows that centroids are fitted on, for each cell, and rounds of that.
ROWS_PER_CELL, ROUNDS = 64, 8
#: Centroids are sent to all tasks, so there are no more of them.
MOST_CELLS = 16_384
#: Vectors that ask for their neighbours when the number of probes is measured, and how many each asks for.
ASKING, NEIGHBOURS = 256, 10
RECALL = 0.95
#: So many times k candidates by code are compared by their vectors.
REFINED = 4


@dataclass(frozen=True)
class Cells:
    """A stored index: its folder, centroids and cells to probe."""

    folder: str
    centroids: np.ndarray
    rows: np.ndarray
    probes: int

    @property
    def share(self) -> float:
        """Of all vectors the part that an average probe of this many cells reads."""
        return min(1.0, self.probes / max(1, len(self.centroids)))


def _lowest(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """The rows whose ids hash lowest; of all rows only hashes are sorted."""
    place = F.xxhash64("chunk_id", F.lit(seed))
    last = vectors.select(place.alias("place")).orderBy("place").limit(rows).agg(F.max("place")).first()[0]
    return vectors.filter(place <= F.lit(last)) if last is not None else vectors.limit(0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _sums(centroids: np.ndarray):
    """Of each cell: the sum and number of this task's vectors in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = dense._matrix(batch["vector"], centroids.shape[1])
            cell = (vectors @ centroids.T).argmax(axis=1)
            np.add.at(sums, cell, vectors)
            n += np.bincount(cell, minlength=len(n))
        own = np.flatnonzero(n)
        listed = pa.ListArray.from_arrays(np.arange(0, len(own) * centroids.shape[1] + 1, centroids.shape[1], dtype=np.int32), pa.array(sums[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), listed, pa.array(n[own])], ["cell", "total", "n"])

    return run


def fit(vectors: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of unit length.  A round of k-means is one pass over the sample; what comes to the driver is a row a cell."""
    sample = _lowest(vectors.select(F.col("chunk_id").cast("long"), "vector"), cells * ROWS_PER_CELL, seed).persist()
    first = _lowest(sample, cells, seed + 1).orderBy("chunk_id").limit(cells).collect()
    if not first:
        sample.unpersist()
        return np.zeros((0, 0))
    centroids = _unit(np.array([r.vector for r in first], np.float64))
    dim = centroids.shape[1]
    for _ in range(ROUNDS):
        parts = sample.select("vector").mapInArrow(_sums(centroids), "cell int, total array<double>, n long")
        added = parts.select("cell", F.posexplode("total").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"))
        moved = centroids.copy()
        for r in added.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("total")).collect():  # dim numbers a cell
            moved[r.cell] = [x.x for x in r.total][:dim]
        centroids = _unit(moved)
    sample.unpersist()
    return centroids


def _coded(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = dense._matrix(batch["vector"], centroids.shape[1])
            cell = (vectors @ centroids.T).argmax(axis=1)
            rest = vectors - centroids[cell]
            scale = np.abs(rest).max(axis=1) / 127
            codes = np.rint(np.divide(rest, scale[:, None], out=np.zeros_like(rest), where=scale[:, None] > 0)).astype(np.int8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(centroids.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["chunk_id"], batch["vector"], packed, pa.array(scale.astype(np.float32)), pa.array(cell.astype(np.int32))], ["chunk_id", "vector", "code", "scale", "cell"])

    return run


def build(vectors: DataFrame, folder: str, cells: int | None = None, recall: float = RECALL, seed: int = 0) -> Cells:
    """vectors: chunk_id (long) and vector, of unit length.  Writes the index to folder.  cells: 4 times the root of the number
    of vectors, if none is given."""
    spark, rows = vectors.sparkSession, vectors.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<float>").alias("vector"))
    n = rows.count()
    cells = max(1, min(cells or int(4 * n**0.5), MOST_CELLS, n or 1))
    centroids = fit(rows, cells, seed)
    coded = rows.mapInArrow(_coded(centroids), "chunk_id long, vector array<float>, code binary, scale float, cell int") if n else rows.selectExpr("chunk_id", "vector", "cast('' as binary) as code", "cast(0 as float) as scale", "0 as cell")
    # a cell's rows go to some tasks: a large one to several
    parts = max(1, n // 500_000)
    coded.repartition(F.col("cell"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
    counts = {r.cell: r.n for r in (spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.count("*").alias("n")).collect() if n else [])}
    probes = _measured_probes(rows, spark.read.parquet(f"{folder}/vectors"), centroids, recall, seed) if n else 1
    about = [(i, [float(x) for x in c], int(counts.get(i, 0)), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(about, "cell int, centroid array<double>, n long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Cells:
    try:
        about = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
    except Exception as e:
        raise IndexNotFoundError(f"no vector index in {folder}") from e
    return Cells(folder, np.array([r.centroid for r in about], np.float64), np.array([r.n for r in about]), about[0].probes if about else 1)


def _measured_probes(rows: DataFrame, stored: DataFrame, centroids: np.ndarray, recall: float, seed: int) -> int:
    """The least number of probes that finds this share of some vectors' exact neighbours."""
    asking = _lowest(rows, ASKING, seed + 2).select(F.col("chunk_id").alias("query_id"), "vector")
    near = dense.search(rows, asking, NEIGHBOURS + 1).filter("query_id <> chunk_id")
    found = near.join(stored.select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").collect()  # ASKING * NEIGHBOURS rows
    if not found:
        return 1
    vectors = {r.query_id: r.vector for r in asking.collect()}
    numbers = {q: i for i, q in enumerate(vectors)}
    order = np.argsort(-(np.array(list(vectors.values())) @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort([place[numbers[r.query_id], r.cell] for r in found])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def _scan(query_ids: list, matrix: np.ndarray, probed: np.ndarray, centroids: np.ndarray, k: int, id_type: pa.DataType):
    """The k best by code of each query in a task, with their cells.  probed: cells by queries."""
    near = matrix @ centroids.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(query_ids), -np.inf)
        for batch in batches:
            ids, cell, scale = (batch[c].to_numpy(zero_copy_only=False) for c in ("chunk_id", "cell", "scale"))
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.int8).reshape(len(ids), -1)
            for c in np.unique(cell):
                asking = np.flatnonzero(probed[c])
                own = np.flatnonzero(cell == c)
                for at in range(0, len(own), dense.SLICE):
                    some = own[at : at + dense.SLICE]
                    scores = near[asking, c][:, None] + (matrix[asking] @ codes[some].T.astype(np.float64)) * scale[some]
                    kept = dense._best(kept, floor, scores, ids[some], k, asking)
        numbers, chunks, scores = kept
        yield pa.record_batch([pa.array(query_ids, id_type).take(pa.array(numbers)), pa.array(chunks), pa.array(scores)], ["query_id", "chunk_id", "near"])

    return run


def search(index: Cells, spark: SparkSession, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """queries: query_id and vector.  The k nearest that the probed cells hold, with exact score and rank; ties go to the
    smaller chunk_id.  Queries go to the tasks in blocks of a bounded number."""
    asked = queries.select("query_id", "vector")
    kind = asked.schema["query_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    nothing = asked.limit(0).select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    k, probes = max(1, k), min(probes or index.probes, max(1, len(index.centroids)))
    blocks, parts = -(-asked.count() // dense.BLOCK_ROWS), []
    for block in range(blocks if len(index.centroids) else 0):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about BLOCK_ROWS
        if not rows:
            continue
        matrix = np.array([r.vector for r in rows], np.float64)
        if matrix.shape[1] != index.centroids.shape[1]:
            raise MissingEmbeddingsError(f"a query that doesn't have {index.centroids.shape[1]} dimensions")
        closest = np.argpartition(-(matrix @ index.centroids.T), probes - 1, axis=1)[:, :probes]
        probed = np.zeros((len(index.centroids), len(rows)), bool)
        probed[closest, np.arange(len(rows))[:, None]] = True
        stored = spark.read.parquet(f"{index.folder}/vectors").filter(F.col("cell").isin([int(c) for c in np.flatnonzero(probed.any(axis=1))]))
        run = _scan([r.query_id for r in rows], matrix, probed, index.centroids, REFINED * k, id_type)
        coarse = stored.select("chunk_id", "cell", "code", "scale").mapInArrow(run, f"query_id {kind}, chunk_id long, near double")
        best = top_k(coarse.withColumnRenamed("near", "score"), REFINED * k).select("query_id", "chunk_id")  # BLOCK_ROWS * REFINED * k rows at most
        own = asked.join(F.broadcast(spark.createDataFrame([(r.query_id,) for r in rows], f"query_id {kind}")), "query_id", "left_semi")
        met = stored.select("chunk_id", "vector").join(best, "chunk_id").join(own.withColumnRenamed("vector", "q"), "query_id")
        parts.append(top_k(met.select("query_id", "chunk_id", F.round(dense.dot(F.col("q"), F.col("vector")), 9).alias("score")), k))
    found = nothing
    for i, part in enumerate(parts):
        found = part if not i else found.unionByName(part)
    return found
