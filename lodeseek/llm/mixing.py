"""Mixing sources to target weights by Poisson replication.

A source with weight w of a mixture of T bytes, that holds b bytes, has its documents repeated w T / b
times on average.  Each document's count is the inverse of the Poisson distribution with that mean at a
number in [0, 1) hashed from the seed, its id and its text: the draw is the same in every run and on
every machine, and nothing is gathered.  Rows are exploded by their counts and shuffled globally: a
hash of the document and the copy's number decides partition and place.

Native throughout.  Per source there is one small row with the mean and, up to ``TABULATED_MEAN``, the
cumulative probabilities; over that, each document sums the same terms for itself, as many as its copies by
order of size, so that the row stays small whatever the mean.  These rows are sent to all tasks only if there are at most ``BROADCAST_SOURCES``, else the documents are joined on the
source and a salt, for each value of which the rates are repeated, so that a hot source is dealt out.

Defined results: a null source is a source of its own; null and empty texts weigh ``ROW_BYTES`` like the
fixed part of any row; rows that agree in id and text draw the same count; a source without a weight in
an explicit table has rate 0; an empty table gives an empty mixture.  Means have no bound, except that a
size that a caller asks for (``total_bytes``) is an error if it repeats a source over ``LARGEST_MEAN`` times.  Columns of the documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.shared import stash

ROW_BYTES = 8
BROADCAST_SOURCES = 10_000
SALTS = 16
#: With an explicit total_bytes only.
LARGEST_MEAN = 5_000
TABULATED_MEAN = 100
SEED = "mix-1"
#: Without weights: a source's share of the mixture is as its bytes to this power.
EVENNESS = 0.5


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the parts' MD5."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _last(mean: Column) -> Column:
    """Where the rest of the distribution is below the hash's resolution."""
    return F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")


def _log_term(log_p: Column, mean: Column, k: Column) -> Column:
    """log P(X = k) from that of k - 1."""
    return F.when(k == 0, -mean).otherwise(log_p + F.log(mean) - F.log(k.cast("double")))


def cumulative_poisson(mean: Column) -> Column:
    """P(X <= k) for k from 0 to _last(mean)."""
    start = F.struct(F.array().cast("array<double>").alias("sums"), F.lit(0.0).alias("sum"), (-mean).alias("log_p"))

    def step(state: Column, k: Column) -> Column:
        log_p = _log_term(state["log_p"], mean, k)
        total = state["sum"] + F.exp(log_p)
        return F.struct(F.concat(state["sums"], F.array(total)).alias("sums"), total.alias("sum"), log_p.alias("log_p"))

    sums = F.aggregate(F.sequence(F.lit(0), _last(mean)), start, step, lambda s: s["sums"])
    return F.when(mean > 0, sums).otherwise(F.array(F.lit(1.0)))


def poisson_count(mean: Column, u: Column) -> Column:
    """How many entries of cumulative_poisson(mean) are at most u, without the array."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), (-mean).alias("log_p"))

    def step(state: Column, k: Column) -> Column:
        log_p = _log_term(state["log_p"], mean, k)
        total = state["sum"] + F.exp(log_p)
        return F.struct((state["n"] + (total <= u).cast("int")).alias("n"), total.alias("sum"), log_p.alias("log_p"))

    return F.aggregate(F.sequence(F.lit(0), _last(mean)), start, step, lambda s: s["n"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total_bytes: int | None = None, evenness: float = EVENNESS) -> DataFrame:
    """source, bytes, rate (mean repetitions) and cumulative, null over TABULATED_MEAN.  weights: source and weight (any scale);
    total_bytes: of the mixture, as many as docs has if not given."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(size).cast("double").alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("bytes", F.lit(evenness)))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighed = stash(weighed, "sources")
    sums = weighed.agg(F.sum("weight").alias("weight"), F.sum("bytes").alias("bytes")).first()
    total = float(total_bytes or sums["bytes"] or 0)
    rate = F.col("weight") / F.lit(sums["weight"] or 1.0) * F.lit(total) / F.col("bytes")
    if total_bytes:
        rate = F.when(rate <= LARGEST_MEAN, rate).otherwise(F.raise_error(F.lit(f"a source is to be repeated over {LARGEST_MEAN} times")).cast("double"))
    rates = weighed.select("source", F.col("bytes").cast("long").alias("bytes"), rate.alias("rate"))
    return stash(rates.withColumn("cumulative", F.when(F.col("rate") <= TABULATED_MEAN, cumulative_poisson(F.col("rate")))), "rates")


def mix(docs: DataFrame, rates: DataFrame, seed: str = SEED, numbered: bool = True) -> DataFrame:
    """The columns of docs, and if numbered with _copy (0 to the document's count, less one) and _place (a hash that rows
    are in the order of, inside each partition), in place of columns with these names."""
    if numbered:
        docs = docs.drop("_copy", "_place")
    plain = {c: c if c in ("doc_id", "text", "source") else f"_c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    own = docs.toDF(*plain.values())
    identity = (F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    drawn = own.withColumn("_u", unit_hash(*identity))
    known = rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), "cumulative")
    if rates.count() <= BROADCAST_SOURCES:
        joined = drawn.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")))
    else:
        salted = drawn.withColumn("_salt", (F.col("_u") * 1e9 % SALTS).cast("int"))
        spread = known.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_spread")))
    listed = F.size(F.filter("cumulative", lambda c: c <= F.col("_u")))
    count = F.when(F.col("cumulative").isNotNull(), listed).otherwise(poisson_count(F.col("_rate"), F.col("_u")))
    counted = joined.withColumn("_count", count).filter("_count > 0")
    copies = counted.select(*own.columns, F.explode(F.sequence(F.lit(0), F.col("_count") - 1)).alias("_copy"))
    placed = copies.withColumn("_place", F.xxhash64(F.lit(seed), "doc_id", "text", "_copy"))
    mixed = placed.repartition(F.col("_place")).sortWithinPartitions("_place")
    return mixed.select(*(F.col(new).alias(old) for old, new in plain.items()), *(["_copy", "_place"] if numbered else []))
