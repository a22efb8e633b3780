"""Token counts with a digest cache.

The cache is a folder of Parquet files with the tokenizer's version digest, the digest of the content as
the tokenizer sees it, and the count.  The documents' digests are written to a small table and joined to the cache;
only texts without a count are looked at again, reduced to one of each digest before and after their shuffle,
encoded, and their counts appended.  A digest that very many documents share is not dealt by its value
(``shared.join_counted``).

Content is normalised no further than the tokenizer leaves counts alone: a null text is an empty one, and
equal bytes are equal content.  The version digest covers the tokenizer's file and the library's version.

Defined results: null and empty texts have 0 bytes and whatever the tokenizer gives for an empty text; very long
texts are encoded whole, one at a time; repeated rows come back as often as they came, and equal texts have equal
counts; a count that was appended twice, by jobs that ran at the same time, is read once; an empty table gives an
empty result and appends nothing.  Columns besides those named aren't looked at, and none of these can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.shared import join_counted, stash

#: Missing digests of 32 bytes that may be sent to all tasks.
BROADCAST_DIGESTS = 500_000
CACHE = "tokenizer string, digest binary, n_tokens long"
LIBRARY = {".json": "tokenizers", ".model": "sentencepiece"}


def version_digest(path: str) -> str:
    """Of a tokenizer's file and the library that reads it."""
    library = LIBRARY[Path(path).suffix]
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {version(library)}".encode()).hexdigest()


def load_counter(path: str) -> Callable[[str], int]:
    """A function from text to its number of tokens, without added ones."""
    if Path(path).suffix == ".model":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in batches:
            counts = [count(x.as_py()) for x in batch["text"]]
            yield pa.record_batch([batch["digest"], pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """None if nothing was ever appended."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(CACHE).parquet(folder)


def _counts(cache: DataFrame, tokenizer: str) -> DataFrame:
    own = cache.filter(F.col("tokenizer") == tokenizer)
    return own.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_folder: str, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs with n_bytes and n_tokens.  Appends what the cache hasn't got."""
    spark, tokenizer = docs.sparkSession, version_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    plain = {c: f"_{i}" for i, c in enumerate(columns)}  # no name can clash
    rows = stash(docs.select(*(F.col(c).alias(new) for c, new in plain.items()), digest, F.octet_length(text).cast("long").alias("n_bytes")), "text-digests")
    counted = stash(rows.groupBy("digest").agg(F.count("*").alias("n")), "distinct-digests")
    distinct = docs.select(digest, text.alias("text"))
    cache = read_cache(spark, cache_folder)
    if cache is not None:
        missing = stash(counted.join(_counts(cache, tokenizer), "digest", "left_anti").select("digest"), "missing-digests")
        if missing.count() <= BROADCAST_DIGESTS:  # texts that have a count aren't shuffled
            distinct = distinct.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            distinct = distinct.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
    else:
        distinct = distinct.groupBy("digest").agg(F.first("text").alias("text"))
    encoded = distinct.mapInArrow(_encode_batches(tokenizer_path), "digest binary, n_tokens long")
    encoded.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_folder)
    stored = stash(counted.join(_counts(spark.read.schema(CACHE).parquet(cache_folder), tokenizer), "digest"), "stored-counts")
    return join_counted(rows, stored, "digest").select(*(F.col(new).alias(c) for c, new in plain.items()), "n_bytes", "n_tokens")
