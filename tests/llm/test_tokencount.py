import uuid
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodeseek.llm import tokencount
from lodeseek.llm.shared import shared_folder


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, docs, clashing, rows, name):
    path, cache = public_tokenizers.path(name), f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    if name.endswith(".model"):
        library = SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = Counter((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows)
    for table in (docs, clashing):
        got = tokencount.count_tokens(table, path, cache, ["doc_id"])
        assert Counter(map(tuple, got.collect())) == want


def test_only_misses_are_encoded_and_appended(spark, docs, rows):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    assert tokencount.read_cache(spark, cache) is None
    tokencount.count_tokens(docs.filter("doc_id < 60"), path, cache, ["doc_id"])
    first = tokencount.read_cache(spark, cache).count()
    assert first == len({r[1] for r in rows if r[0] is not None and r[0] < 60})
    wrong = spark.createDataFrame([(tokencount.version_digest(path), b"x", 7)], tokencount.CACHE)
    wrong.write.mode("append").parquet(cache)
    tokencount.count_tokens(docs, path, cache, ["doc_id"])
    assert tokencount.read_cache(spark, cache).count() == 1 + len({r[1] or "" for r in rows})


def test_another_tokenizer_is_another_version(spark, docs):
    cache = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    few = docs.filter("doc_id < 9")
    a, b = (tokencount.count_tokens(few, public_tokenizers.path(n), cache, ["doc_id"]).collect() for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
    assert Counter(map(tuple, a)) != Counter(map(tuple, b))


def test_empty_table(spark, empty):
    cache = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    assert tokencount.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model"), cache, ["doc_id"]).count() == 0


def test_very_common_texts_and_columns_with_any_name(spark):
    """A text in a third of the rows is joined apart from the others; columns may be called as those used inside."""
    from pyspark.sql import functions as F

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    rows = spark.range(1500).select(F.col("id").alias("digest"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit(1).alias("n"))
    got = tokencount.count_tokens(rows, path, cache, ["digest", "n"]).collect()
    library = SentencePieceProcessor(model_file=path)
    assert sorted((r.digest, r.n_tokens) for r in got) == [(i, len(library.encode("the same" if i % 3 == 0 else f"own {i}"))) for i in range(1500)]


def test_the_query_finds_counts_of_an_earlier_run(spark):
    from lodeseek.llm import queries

    cache, sf = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", "/root/testdata/sf0.001"
    spark.conf.set(queries.TOKEN_CACHE, cache)
    try:
        first = Counter(map(tuple, queries.op2_token_counts(spark, sf).collect()))
        size = tokencount.read_cache(spark, cache).count()
        assert Counter(map(tuple, queries.op2_token_counts(spark, sf).collect())) == first
        assert tokencount.read_cache(spark, cache).count() == size > 0
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)
