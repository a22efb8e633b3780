"""Channels to one list of candidates: one aggregation for all channels, then windows per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.lexical import small_or_shuffled, top_k

CHANNELS = ("dense", "bm25", "identifier")
RRF_CONSTANT = 60


def minmax(scored: DataFrame, column: str = "score", by: str = "query_id", to: str = "normal") -> DataFrame:
    """To [0, 1] within each group; a constant is 1, or 0 if it isn't positive."""
    group = Window.partitionBy(by)
    low, high = F.min(column).over(group), F.max(column).over(group)
    scaled = F.when(high > low, (F.col(column) - low) / (high - low)).when(high > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return scored.withColumn(to, scaled)


def gather(channels: dict[str, DataFrame]) -> DataFrame:
    """Each channel: query_id, chunk_id, score (and rank).  One row for each pair with, for each channel,
    its normal score (0 if absent) and rank (null if absent)."""
    parts = []
    for name, scored in channels.items():
        ranked = scored if "rank" in scored.columns else top_k(scored, 2**31 - 1)
        normal = minmax(ranked)
        parts.append(normal.select("query_id", "chunk_id", F.lit(name).alias("channel"), "normal", "rank"))
    rows = reduce(DataFrame.unionByName, parts)
    pick = lambda c, column: F.max(F.when(F.col("channel") == c, F.col(column)))
    return rows.groupBy("query_id", "chunk_id").agg(
        *(F.coalesce(pick(c, "normal"), F.lit(0.0)).alias(f"{c}_n") for c in CHANNELS),
        *(pick(c, "rank").alias(f"{c}_rank") for c in CHANNELS),
    )


def fuse(gathered: DataFrame, weights: DataFrame, k: int, mode: str = "weighted", small: bool = False) -> DataFrame:
    """weights: query_id and weights, a struct with a number for each channel.  The k best candidates with
    score and rank.  small: the caller has seen that weights can go to all tasks."""
    if mode not in ("weighted", "rrf"):
        raise ValueError(f"no fusion {mode!r}")
    w = lambda c: F.col(f"weights.{c}")
    if mode == "weighted":
        terms = [w(c) * F.col(f"{c}_n") for c in CHANNELS]
    else:
        terms = [F.coalesce(w(c) / (RRF_CONSTANT + F.col(f"{c}_rank")), F.lit(0.0)) for c in CHANNELS]
    own = weights.select("query_id", "weights")
    scored = gathered.join(F.broadcast(own) if small else small_or_shuffled(own, 50_000), "query_id")
    scored = scored.withColumn("score", reduce(lambda a, b: a + b, terms)).drop("weights")
    return top_k(scored.filter("score > 0"), k)


def method():
    """The channels that found a candidate, in order of the alphabet."""
    found = F.array(*(F.when(F.col(f"{c}_rank").isNotNull(), F.lit(c)) for c in sorted(CHANNELS)))
    return F.array_join(found, "+")
