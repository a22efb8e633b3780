"""Features of candidates, reranking of the best of them, and what a result says about itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as T

FEATURES = ("semantic", "bm25", "identifier", "function_match", "class_match", "path_match", "doc_overlap", "metadata", "structural")


def _share(of: Column, among: Column) -> Column:
    """The part of the distinct words of one array that the other has."""
    own = F.array_distinct(of)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, among)) / F.size(own)).otherwise(F.lit(0.0))


def feature_words() -> dict[str, Column]:
    """What features are made of, of a chunk's columns; an index stores it beside them."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return {
        "words_function": T.tokens(text("function")),
        "words_class": T.tokens(text("class_name")),
        "words_path": T.tokens(F.regexp_replace(text("file"), r"\.[A-Za-z0-9]*$", "")),
        "words_doc": T.tokens(text("doc")),
        "called": F.transform(F.coalesce("calls", F.array().cast("array<string>")), F.lower),
    }


def features(candidates: DataFrame, chunks: DataFrame, understood: DataFrame, structural: bool = True, keep: tuple[str, ...] = (), small: bool = False) -> DataFrame:
    """Adds FEATURES, each in [0, 1], and the columns of chunks to keep.  structural: 1 if the unit calls a queried name,
    0.5 if a better or worse candidate of the query calls it or is called by it.  Only the candidates' chunks are looked
    at, and if they have the columns of feature_words, no text of theirs.  small: the caller has seen that the candidates
    can go to all tasks."""
    names = {"words_function": "_fn", "words_class": "_class", "words_path": "_path", "words_doc": "_doc", "called": "_calls"}
    stored = set(names) <= set(chunks.columns)
    words = {c: F.col(c) for c in names} if stored else feature_words()
    needed = ("function", *names) if stored else ("function", "class_name", "file", "doc", "calls")
    about = [c for c in dict.fromkeys((*needed, *keep)) if c not in candidates.columns]
    found = (F.broadcast(candidates) if small else candidates).join(chunks.select("chunk_id", *about), "chunk_id")
    found = found.select(
        *candidates.columns,
        *keep,
        F.lower(F.coalesce("function", F.lit(""))).alias("_function"),
        *(own.alias(names[c]) for c, own in words.items()),
    )
    asked = understood.select("query_id", F.concat("tokens", "expansion").alias("_asked"), F.array_distinct("tokens").alias("_tokens"), F.col("entity_names").alias("_entities"))
    rows = found.join(F.broadcast(asked) if small else asked, "query_id")
    rows = rows.withColumns({
        "semantic": F.col("dense_n"),
        "bm25": F.col("bm25_n"),
        "identifier": F.col("identifier_n"),
        "function_match": _share(F.col("_fn"), F.col("_asked")),
        "class_match": _share(F.col("_class"), F.col("_asked")),
        "path_match": _share(F.col("_path"), F.col("_asked")),
        "doc_overlap": _share(F.col("_tokens"), F.col("_doc")),
    })
    rows = rows.withColumn("metadata", (F.col("function_match") + F.col("class_match") + F.col("path_match") + F.col("doc_overlap")) / 4)
    if not structural:
        return rows.withColumn("structural", F.lit(0.0)).drop(*(c for c in rows.columns if c.startswith("_")))
    group = Window.partitionBy("query_id")
    names = F.collect_set(F.when(F.col("_function") != "", F.col("_function"))).over(group)  # candidates of a query are few
    called = F.array_distinct(F.flatten(F.collect_list("_calls").over(group)))
    direct = F.size(F.array_intersect("_calls", "_entities")) > 0
    near = (F.size(F.array_intersect(F.col("_calls"), F.array_remove(names, F.col("_function")))) > 0) | F.array_contains(called, F.col("_function"))
    rows = rows.withColumn("structural", F.when(direct, 1.0).when(near, 0.5).otherwise(0.0))
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


def linear_score(weights: dict[str, float]) -> Column:
    unknown = set(weights) - set(FEATURES)
    if unknown:
        raise ValueError(f"no features {', '.join(sorted(unknown))}; there are {', '.join(FEATURES)}")
    return reduce(lambda a, b: a + b, (F.lit(float(w)) * F.col(f) for f, w in weights.items()), F.lit(0.0))


def rerank(featured: DataFrame, new_score: Column, top_n: int) -> DataFrame:
    """The first top_n of each query are ordered by new_score; the others follow in their order, with scores
    below the least of these."""
    group = Window.partitionBy("query_id")
    head = F.col("rank") <= top_n
    rows = featured.withColumn("_new", F.when(head, new_score))
    floor, ceiling = F.min("_new").over(group), F.max(F.when(~head, F.col("score"))).over(group)
    shifted = F.col("score") - F.greatest(ceiling - floor, F.lit(0.0)) - F.lit(1e-9)
    rows = rows.withColumn("_final", F.when(head, F.col("_new")).otherwise(shifted))
    order = Window.partitionBy("query_id").orderBy(F.desc("_final"), "rank", "chunk_id")
    return rows.withColumn("_place", F.row_number().over(order)).drop("score", "rank", "_new").withColumnRenamed("_final", "score").withColumnRenamed("_place", "rank")


def explanation() -> Column:
    """Why a result is there, of its features."""
    reasons = {
        "defines a queried identifier": F.col("identifier") >= 1,
        "calls a queried name": F.col("structural") >= 1,
        "function name matches query terms": F.col("function_match") > 0,
        "high semantic similarity": F.col("semantic") >= 0.6,
        "strong lexical match": F.col("bm25") >= 0.6,
        "file path matches": F.col("path_match") > 0,
    }
    said = F.array_compact(F.array(*(F.when(test, F.lit(reason)) for reason, test in reasons.items())))
    return F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise("weaker partial match")


class TreeReranker:
    """Gradient-boosted regression trees on graded candidates.  Pointwise: Spark has no listwise learner."""

    def __init__(self) -> None:
        self.model = None

    def train(self, featured: DataFrame, label: str = "label", trees: int = 20, depth: int = 4) -> TreeReranker:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(featured.withColumn(label, F.col(label).cast("double")))
        self.model = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_predicted", maxIter=trees, maxDepth=depth, seed=0).fit(rows)
        return self

    def rerank(self, featured: DataFrame, top_n: int) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        if self.model is None:
            raise RuntimeError("the reranker is not trained")
        rows = self.model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(featured)).drop("_features")
        return rerank(rows, F.col("_predicted"), top_n).drop("_predicted")
