"""Copies: exact ones in a corpus, and versions of one unit among the results of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.operators.dense import dot

SAME_BODY = 0.6


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs: doc_id and text.  content_hash, copies, first_id of texts that occur more than once."""
    hashed = docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def collapse_identities(results: DataFrame, by: str = "query_id") -> DataFrame:
    """The best result of each identity, with also_in: the versions of the others, by score."""
    group = Window.partitionBy(by, "identity")
    order = group.orderBy(F.desc("score"), "chunk_id")
    listed = F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_id", F.concat_ws(":", "version", F.coalesce("function", F.lit(""))).alias("n"))).over(group)
    rows = results.withColumn("_place", F.row_number().over(order)).withColumn("_all", F.array_sort(listed))
    names = F.transform(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(1))), lambda x: x["n"])
    return rows.filter("_place = 1").withColumn("also_in", F.when(F.size("_all") > 1, names).otherwise(F.array().cast("array<string>"))).drop("_place", "_all")


def _same_unit(kept: Column, row: Column, threshold: float) -> Column:
    """One identity; or one file in two versions with near vectors and similar bodies, a renamed unit.  Vectors and bodies are
    looked at only where file and version fit."""
    union = F.size(F.array_union(kept["body"], row["body"]))
    bodies = F.when(union > 0, F.size(F.array_intersect(kept["body"], row["body"])) / union >= SAME_BODY).otherwise(F.lit(True))
    near = F.when(dot(kept["vector"], row["vector"]) >= threshold, bodies).otherwise(F.lit(False))
    renamed = F.when((kept["file"] == row["file"]) & (kept["version"] != row["version"]), near).otherwise(F.lit(False))
    return F.coalesce(F.when(kept["identity"] == row["identity"], F.lit(True)).otherwise(renamed), F.lit(False))


def collapse_versions(results: DataFrame, threshold: float = 0.9) -> DataFrame:
    """results: query_id, chunk_id, score, identity, file, version, function, code, vector; some hundreds a
    query.  Down the list, a result goes into the first kept one that has its identity, or that stands in the
    same file of another version with a near vector and a similar body.  An absorbed result absorbs nothing, so the order
    matters: a fold over each query's list, whose state is the kept results with what they have absorbed."""
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.array_distinct(F.filter(T.ascii_tokens(F.col("code")), lambda t: t != F.lower(text("function"))))
    row = F.struct(
        (-F.col("score").cast("double")).alias("order"),
        F.col("chunk_id").cast("long").alias("chunk_id"),
        *(text(c).alias(c) for c in ("identity", "file", "version", "function")),
        F.transform("vector", lambda x: x.cast("double")).alias("vector"),
        body.alias("body"),
        F.array().cast("array<string>").alias("also_in"),
    )
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    same_fields = ("order", "chunk_id", "identity", "file", "version", "function", "vector", "body")

    def step(kept: Column, row: Column) -> Column:
        into = F.array_position(F.transform(kept, lambda k: _same_unit(k, row, threshold)), True)
        name = F.concat_ws(":", row["version"], row["function"])
        added = lambda k, i: F.when(i + 1 == into, F.struct(*(k[f].alias(f) for f in same_fields), F.concat(k["also_in"], F.array(name)).alias("also_in"))).otherwise(k)
        return F.when(into > 0, F.transform(kept, added)).otherwise(F.concat(kept, F.array(row)))

    kept = listed.select("query_id", F.explode(F.aggregate("rows", F.slice("rows", 1, 0), step)).alias("kept"))
    return results.drop("also_in").join(kept.select("query_id", "kept.chunk_id", "kept.also_in"), ["query_id", "chunk_id"])
