import re
from collections import Counter

from lodeseek.llm import decontaminate as d

ITEMS = [
    (1, "the of and to in is house river think with the of and"),
    (2, "Über und der, DIE das ist nicht!"),
    (10, "river"),
    (3, None),
    (4, " .. "),
    (None, "some text here"),
    (1, "think with the of and to in is house river"),
]


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_search(text, items):
    words, hit, met = plain_words(text), set(), set()
    for item, body in items:
        own = plain_words(body)
        n = min(10, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for at in range(len(words) - n + 1) if n else ():
            if tuple(words[at : at + n]) in windows:
                hit.update(range(at, at + n))
                met.add(item)
    return len(words), len(hit), tuple(sorted(str(i) for i in met if i is not None))


def planted(spark, rows):
    texts = [*(r[1] for r in rows), "x " + ITEMS[0][1] + " y " + ITEMS[0][1].upper(), "river-river, Über und der die das ist nicht", "some  TEXT here some text here"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def check(spark, rows, **options):
    texts, docs = planted(spark, rows)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.find_benchmark(docs, benchmark, ["doc_id"], **options).withColumn("n_hit", d.hit_words(d.F.col("spans"))).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got} == {(i, *plain_search(t, ITEMS)) for i, t in enumerate(texts)}


def test_equals_brute_force(spark, rows):
    check(spark, rows)


def test_blocks_of_items_give_the_same(spark, rows):
    check(spark, rows, block_bytes=30)


def test_clean_documents_keep_their_columns(spark, clashing, docs, rows):
    benchmark = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = d.clean_documents(clashing, benchmark)
    assert kept.columns == clashing.columns
    want = Counter((r[0], r[1]) for r in rows if not plain_search(r[1], ITEMS[:2])[1])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_empty_tables(spark, empty, docs, rows):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.find_benchmark(empty, nothing, ["doc_id"]).count() == 0
    assert d.clean_documents(docs, nothing).count() == len(rows)
