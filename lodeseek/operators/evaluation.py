"""Ranking quality over runs and judgements in long form, and percentiles of timings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.lexical import is_small, small_or_shuffled

#: Items too short for a key that are looked for at once.
SHORT_ITEMS = 1000
#: Texts whose words a task looks at together.
TEXTS_AT_ONCE = 1000
#: Leading bits of a hash by which rows are counted to find the middle.
COUNTED_BITS = 12


def ranked_run(run: DataFrame, k: int) -> DataFrame:
    """run: query_id, doc_id, score.  The first k of each query; ties go to the smaller doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return run.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def per_query(run: DataFrame, qrels: DataFrame, k: int, deeper: int | None = None) -> DataFrame:
    """qrels: query_id, doc_id, rel.  query_id, ndcg, mrr and recall at k, for every judged query; with deeper
    also deep_recall, at that rank."""
    met = qrels.join(ranked_run(run, deeper or k).select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id"))
    discount = lambda rank: F.log2(rank.cast("double") + 1)
    rows = met.withColumn("ideal_rank", ideal).withColumn("near", F.when(F.col("rank") <= k, F.col("rank")))
    positive = F.col("rel") > 0
    share = lambda hits: F.when(F.col("positives") > 0, F.col(hits) / F.col("positives")).otherwise(0.0)
    return rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("near").isNotNull(), F.col("rel") / discount(F.col("near"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal_rank") <= k, F.col("rel") / discount(F.col("ideal_rank"))).otherwise(0.0)).alias("ideal"),
        F.min(F.when(positive, F.col("near"))).alias("first"),
        F.count_if(positive & F.col("near").isNotNull()).alias("hits"),
        F.count_if(positive & F.col("rank").isNotNull()).alias("deep_hits"),
        F.count_if(positive).alias("positives"),
    ).select(
        "query_id",
        F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        share("hits").alias("recall"),
        *([share("deep_hits").alias("deep_recall")] if deeper else []),
    )


def evaluate(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: ndcg_at_10, mrr_at_10, recall_at_10, recall_at_100 and n_queries, means over judged queries."""
    means = {"ndcg_at_10": "ndcg", "mrr_at_10": "mrr", "recall_at_10": "recall", "recall_at_100": "deep_recall"}
    return per_query(run, qrels, 10, 100).agg(*(F.avg(c).alias(name) for name, c in means.items()), F.count("*").alias("n_queries"))


def percentiles(timings: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median and 95th percentile, exact with linear interpolation."""
    return timings.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def duplicate_rate(results: DataFrame, unit: str = "identity", k: int = 10) -> DataFrame:
    """query_id and the share of k places taken by a unit seen above; k divides even shorter lists."""
    return results.filter(F.col("rank") <= k).groupBy("query_id").agg(((F.count("*") - F.count_distinct(unit)) / k).alias("duplicate_rate"))


def best_trial(scored: DataFrame) -> DataFrame:
    """trial and score of the best, the earliest among equals."""
    return scored.select(F.max_by(F.struct("trial", "score"), F.struct("score", -F.col("trial"))).alias("best")).select("best.*")


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: doc_id, text; items: query_id, item.  query_id and doc_id wherever the text holds the item.

    An item's second to fourth words stand between blanks in every text that holds it, so these three-word keys
    give the candidates, and containment decides.  Where the items can go to all tasks, both are done where a text is
    read, and only pairs that hold are dealt; otherwise keys, without texts, are joined.  Items of fewer than five
    words have no such key and are looked for in all texts, in blocks.  Empty items are in no text."""
    asked = items.filter("length(item) > 0").withColumn("keyed", F.size(F.split("item", " ")) > 4)
    keyed = asked.filter("keyed").select("query_id", "item")
    found = _held(docs, keyed) if is_small(keyed) else _held_by_join(docs, keyed)
    short = asked.filter("not keyed").select("query_id", "item")
    blocks = -(-short.count() // SHORT_ITEMS)
    for block in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("query_id", "item"), F.lit(blocks)) == block)  # about SHORT_ITEMS
        found = found.unionByName(docs.join(F.broadcast(own), F.contains("text", F.col("item"))).select("query_id", "doc_id"))
    return found.distinct()


def _held(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Pairs of few items, of five words or more, and documents that hold them.  A task keeps no pair."""
    rows = keyed.toArrow().combine_chunks()  # which the caller has seen to be small
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((keyed, "query_id"), (docs, "doc_id"))]
    return docs.filter("text is not null").select("doc_id", "text").mapInArrow(_holding(rows["query_id"], rows["item"].to_pylist()), ", ".join(kinds))


def _holding(query_ids: pa.ChunkedArray, items: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words are numbered, and a key is one number of its three; keys ascend, of which each has one item or more."""
    keys = [item.split(" ")[1:4] for item in items]
    words = pa.array(sorted({w for key in keys for w in key}), pa.string())
    size = max(1, len(words))
    numbers = pc.index_in(pa.array([w for key in keys for w in key], pa.string()), words).to_numpy().astype(np.int64).reshape(-1, 3)
    codes = numbers @ np.array([size * size, size, 1])
    order = np.argsort(codes, kind="stable")
    codes, starts = np.unique(codes[order], return_index=True)
    ends = [*starts[1:], len(items)]

    def candidates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and of the keys in them, each pair once, by key."""
        split = pc.split_pattern(texts, " ")
        at = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        found = pc.fill_null(pc.index_in(split.flatten(), words), -1).to_numpy().astype(np.int64)
        first = np.flatnonzero((found[:-2] >= 0) & (found[1:-1] >= 0) & (found[2:] >= 0) & (at[:-2] == at[2:])) if len(found) > 2 else np.zeros(0, np.int64)
        told = (found[first] * size + found[first + 1]) * size + found[first + 2]
        place = np.minimum(np.searchsorted(codes, told), len(codes) - 1)
        known = codes[place] == told
        pairs = np.unique(place[known] * len(texts) + at[first[known]])
        return pairs % len(texts), pairs // len(texts)

    def held(rows: pa.RecordBatch, key: int) -> Iterator[tuple[int, pa.Array]]:
        """Of rows with the key: its items' numbers, and the documents that hold each."""
        for item in order[starts[key] : ends[key]].tolist():
            yield item, rows["doc_id"].filter(pc.match_substring(rows["text"], items[item]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if items else 0, TEXTS_AT_ONCE):
                own = batch.slice(start, TEXTS_AT_ONCE)
                at, which = candidates(own["text"])
                holding = [(item, ids) for key in np.unique(which) for item, ids in held(own.take(pa.array(at[which == key])), key)]
                if holding:
                    asks = pa.array(np.repeat([item for item, _ in holding], [len(ids) for _, ids in holding]))
                    yield pa.record_batch([query_ids.take(asks).combine_chunks(), pa.concat_arrays([ids for _, ids in holding])], ["query_id", "doc_id"])

    return run


def _held_by_join(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The same for any number of items."""
    keys = keyed.select("query_id", F.array_join(F.slice(F.split("item", " "), 2, 3), " ").alias("key"))
    triples = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))
    told = docs.select("doc_id", F.split("text", " ").alias("w")).filter("size(w) > 2").select("doc_id", F.explode(triples).alias("key"))
    pairs = told.join(small_or_shuffled(keys), "key").select("doc_id", "query_id").distinct().persist()  # without texts
    whole = docs.select("doc_id", "text").join(small_or_shuffled(pairs), "doc_id").join(small_or_shuffled(keyed), "query_id")
    return whole.filter(F.contains("text", F.col("item"))).select("query_id", "doc_id")


def halves(rows: DataFrame, key: str, bits: int, tie: str) -> DataFrame:
    """Adds half: 1 for the first half of the rows by key (a hash of so many bits) and tie, 2 for the others; of
    an odd number the first half has one more.  Rows are numbered inside ranges of the hash alone."""
    ranged = rows.withColumn("_range", F.shiftright(F.coalesce(key, F.lit(0)), bits - COUNTED_BITS))
    counts = sorted(ranged.groupBy("_range").count().collect())  # at most 2 ** COUNTED_BITS rows
    left, middle = -(-sum(n for _, n in counts) // 2), 0
    for middle, n in counts:
        if n >= left:
            break
        left -= n
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key, tie))
    first = (F.col("_range") < middle) | ((F.col("_range") == middle) & (F.col("_place") <= left))
    return ranged.withColumn("_place", place).withColumn("half", F.when(first, 1).otherwise(2).cast("long")).drop("_range", "_place")
