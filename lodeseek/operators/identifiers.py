"""Exact names: what a unit defines, calls or is filed under."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators import blocks
from lodeseek.operators.lexical import is_small, small_or_shuffled, top_k

ROLE_SCORES = {"defined": 1.0, "stem": 0.8, "called": 0.5}


def _roles() -> dict[str, Column]:
    """The names of a chunk in each role.  A method also defines its class's name."""
    lower = lambda a: F.transform(a, F.lower)
    names = {
        "defined": lower(F.array(*(F.coalesce(c, F.lit("")) for c in ("function", "class_name", "parent")))),
        "called": lower(F.coalesce("calls", F.array().cast("array<string>"))),
        "stem": F.array(T.file_stem(F.col("file"))),
    }
    return {role: F.array_except(F.array_distinct(n), F.array(F.lit(""))) for role, n in names.items()}


def build(chunks: DataFrame) -> DataFrame:
    """chunk_id, name, role of chunks."""
    roles = F.array(*(F.struct(F.lit(role).alias("role"), n.alias("names")) for role, n in _roles().items()))
    return chunks.select("chunk_id", F.explode(roles).alias("r")).select("chunk_id", F.explode("r.names").alias("name"), "r.role")


def search(identifiers: DataFrame, understood: DataFrame, small: bool = False) -> DataFrame:
    """query_id, chunk_id and score: the best role in which a unit has one of the query's names or files.  small: the
    caller has seen that the queries' names can go to all tasks."""
    names = understood.select("query_id", F.explode("entity_names").alias("name"), F.lit(False).alias("is_file"))
    files = understood.select("query_id", F.explode(F.transform("file_names", T.file_stem)).alias("name"), F.lit(True).alias("is_file"))
    asked = names.unionByName(files).distinct()
    asked = F.broadcast(asked) if small else small_or_shuffled(asked)
    met = identifiers.join(asked, "name").filter((F.col("role") == "stem") == F.col("is_file"))
    role_score = F.create_map(*(F.lit(x) for pair in ROLE_SCORES.items() for x in pair))[F.col("role")]
    return met.groupBy("query_id", "chunk_id").agg(F.max(role_score).alias("score"))


def best(chunks: DataFrame, understood: DataFrame, k: int) -> DataFrame:
    """As search() over build(chunks), cut to the k best of each query, with rank.  chunks has one row for each chunk_id.  Where the
    names of the queries can go to all tasks, a chunk meets them in its own row, and pairs stay in the task."""
    names = understood.select("query_id", F.explode(F.array_distinct("entity_names")).alias("term"), F.lit(1.0).alias("weight"))
    files = understood.select("query_id", F.explode(F.array_distinct(F.transform("file_names", T.file_stem))).alias("term"), F.lit(1.0).alias("weight"))
    few = chunks.schema["chunk_id"].dataType.simpleString() in ("bigint", "int") and is_small(names) and is_small(files)
    batches = [blocks.batch_of(df) if few else None for df in (names, files)]
    query_ids = pa.concat_arrays([b.query_ids for b in batches]).unique() if None not in batches else None
    cuts = None
    if query_ids is not None:
        batches = [b.among(query_ids) for b in batches]
        columns = np.concatenate([b.columns for b in batches])
        order = np.argsort(columns, kind="stable")
        cuts = blocks.cuts(np.concatenate([batches[0].rows, batches[1].rows + len(batches[0].words)])[order], columns[order], len(query_ids))
    if cuts is None:
        return top_k(search(build(chunks), understood), k)

    def scores(rows: pa.RecordBatch) -> blocks.Scores:
        ids = rows["chunk_id"].to_numpy(zero_copy_only=False)
        by_role = lambda x: dict(zip(ROLE_SCORES, (x[0], x[1], x[0]), strict=True))  # noqa: E731  files for the stem
        met = {role: blocks.found_words(rows[role], b.words) for role, b in by_role(batches).items()}
        for first, last in zip(cuts, cuts[1:], strict=False):
            parts = [b.part(first, last) for b in batches]
            step = min(part.slice_rows for part in parts)
            for start in range(0, len(ids), step):
                stop = min(len(ids), start + step)
                found = np.zeros((last - first, stop - start))
                for role, part in by_role(parts).items():
                    at, numbers, _ = met[role]
                    own = slice(*np.searchsorted(at, [start, stop]))
                    if len(part.numbers):
                        matrix = part.matrix(stop - start, at[own] - start, numbers[own], np.ones(own.stop - own.start))
                        found = np.maximum(found, ((part.weights.T @ matrix.T) > 0) * ROLE_SCORES[role])
                yield ids[start:stop], first, {"names": found}

    rows = chunks.filter("chunk_id is not null").select(F.col("chunk_id").cast("long"), *(n.alias(role) for role, n in _roles().items()))
    kind = understood.schema["query_id"].dataType.simpleString()
    return top_k(blocks.best_in_tasks(rows, blocks.each(scores), query_ids, kind, k).drop("measure"), k)
