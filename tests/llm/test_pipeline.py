"""The pipeline against plain versions of its stages, at sf0.001, and what it must do on a fixture."""

import os
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodeseek.llm import shared
from tests.llm.test_decontaminate import plain_search
from tests.llm.test_langid import plain_counts, plain_scorer
from tests.llm.test_mixing import plain_mix
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert columns[:3] == ["doc_id", "text", "lang"]
    rows = [tuple(r) for r in docs.collect()]
    predict = plain_scorer(plain_counts((r[2], r[1]) for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2))
    told = [r for r in rows for lang, score in [predict(r[1])] if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    classes = plain_components([plain_fingerprint(r[1]) for r in told])
    least = {}
    for r, c in zip(told, classes, strict=True):
        least[c] = min(least.get(c, r), r)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r in least.values() if not plain_search(r[1], items)[1]]
    want = plain_mix(clean)
    before = shared.written()
    got = corpus_pipeline.run(spark, SF)
    assert shared.written() == before + 1  # only the result is left in the shared folder
    assert got.columns == [*columns, "shard", "slot"]
    found = got.collect()
    assert not [f for f in os.listdir(shared.shared_folder(spark).removeprefix("file://")) if f.startswith("near_dedup")]
    slots, size = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        size[r.shard] += len((r.text or "").encode()) + 8
    assert set(slots) <= set(range(corpus_pipeline.SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) <= sum(size.values()) / corpus_pipeline.SHARDS + max(len((r.text or "").encode()) + 8 for r in found)
    assert sorted(r.doc_id for r in found) == sorted(key[0] for key, n in want.items() for _ in range(n))
    assert {r.text for r in found} <= {r[1] for r in rows}


@pytest.mark.parametrize("table", ["docs", "clashing", "empty"])
def test_stages_keep_the_columns(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == [c for c in docs.columns], name
        out.count()


def test_copies_of_one_document_are_dealt_over_shards(spark):
    """Mixing repeats a source of one document some twenty times; sharding has to part these equal rows."""
    docs = spark.range(90_000).selectExpr("id as doc_id", "if(id = 0, repeat('word ', 400), concat('text ', id)) as text", "'en' as lang", "if(id = 0, 'small', 'large') as source", "0L as n_chars")
    mixed = shared.stash(corpus_pipeline.source_mixing(spark, docs, SF), "mixed")
    size = Counter()
    for r in corpus_pipeline.kd_sharding(spark, mixed, SF).collect():
        size[r.shard] += len(r.text) + 8
    assert mixed.filter("doc_id = 0").count() > 10
    assert max(size.values()) <= sum(size.values()) / corpus_pipeline.SHARDS + 2 * 2008
