"""A corpus pipeline of five stages, each an operator of ``lodeseek.llm``.

Language identification, SimHash near-dedup, benchmark decontamination, mixing to target weights and sharding, in this
order.  Each stage gets all that the one before kept, whole, and its decisions take effect.  Stages but the last return the
columns of the documents, whatever further columns there are and whatever their names; the last adds shard and slot.

Defined results, by stage.  A text that is null, empty or without a letter has no language, so its document goes; a null
doc_id teaches no language but its document is judged as any other.  Of near-duplicates, equal rows among them, the one with
the least doc_id stays, rows without one only where no other has one, and of equal doc_ids that with the least hash of its
text.  A null or empty benchmark item is in no document.  A null source is a source of its own.  Equal rows, which mixing
makes, are counted as rows of their own by sharding and can be parted.  Very long texts pass whole.  An empty table passes
all stages and gives an empty result with the columns of a full one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.llm import decontaminate, langid, mixing, sharding, simhash
from lodeseek.llm.shared import release_all_but_last, stash, written

#: A document stays if its language has at least this score; four equal languages would have 0.25.
LEAST_LANGUAGE_SCORE = 0.35
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model can tell, go."""
    return langid.identified(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as drawn for its source: not at all, once or repeatedly."""
    return mixing.mix(docs, mixing.source_rates(docs), numbered=False)


def kd_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there."""
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("kd_tree_sharding", kd_sharding),
]

#: Language models and SimHash have no SQL form; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again, and what it and its
    predecessor have written there before is then deleted."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        release_all_but_last(spark, since)
    return docs
