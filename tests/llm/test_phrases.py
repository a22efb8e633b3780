"""Phrases against a count of everything in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeseek.llm import phrases
from lodeseek.llm.queries import op12_phrase_mining

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least, top=phrases.TOP, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    parts = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if a >= f[lang, w[i : i + k]]}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in parts:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def random_rows(seed, count=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "éa", "ÉA", "a\xa0b", "x" * 300, "1", "-", "is", "\x00"]
    seams = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "?!", ":", ";", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(seams) for _ in range(rng.randint(0, 60)))) for _ in range(count)]
    return rows + [("en", None), (None, None), ("en", ""), ("de", " .. "), rows[0], rows[0], ("de", "new york is " * 3000), ("en", "a " * 2000)]


@pytest.mark.parametrize("least,bits,block", [(5, 26, 1 << 21), (5, 6, 40), (300, 10, 500), (2, 12, 1)])
def test_mining(spark, least, bits, block):
    """Also where the sketch lets nearly everything through, and where texts are cut into tiny blocks."""
    rows = random_rows(least)
    found = phrases.mine(spark.createDataFrame(rows, "lang string, text string").repartition(5), min_count=least, bits=bits, block_bytes=block)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least)


def test_top_and_shorter(spark):
    rows = random_rows(3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, rank int")
    found = phrases.mine(docs, longest=3, min_count=4, top=5, bits=16)
    assert sorted(map(tuple, found.collect())) == brute(rows, 4, 5, 3)
    assert phrases.mine(docs.limit(0)).collect() == []


def test_sketch_never_counts_too_little():
    rng = np.random.default_rng(0)
    hashes = phrases._mixed(rng.integers(0, 500, 20_000).astype(np.uint64))
    sketches = [phrases.Sketch(8, 100) for _ in range(4)]
    for sketch, some in zip(sketches, np.array_split(hashes, 4), strict=True):
        for part in np.array_split(some, 7):
            sketch.add(part)
    batches = [b for s in sketches for b in _as_batches(s)]
    full = {number: bits for batch in phrases._merge(iter(batches), 100, 8) for number, bits in zip(batch["chunk"].to_pylist(), batch["full"].to_pylist(), strict=True)}
    kept = phrases.Kept(8, {1: [full.get(row, bytes(32)) for row in range(phrases.ROWS)]})
    values, n = np.unique(hashes, return_counts=True)
    assert kept.of(1, values[n >= 100]).all()


def _as_batches(sketch):
    import pyarrow as pa

    for number, at, n in sketch.chunks():
        yield pa.RecordBatch.from_pydict({"chunk": [number], "at": [at], "n": [n]})


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits, and so does l * r."""
    big = 5_000_000_000_000
    counts = spark.createDataFrame([("x", 0, "", 9 * big), ("x", 1, "p", 7 * big + 1), ("x", 1, "q", 3 * big), ("x", 2, "p q", big + 3)], "lang string, k int, phrase string, f long")
    row = phrases.scored(counts).first()
    assert (row.l, row.r, row.score) == (7 * big + 1, 3 * big, 1000 * (big + 3) * 9 * big // ((7 * big + 1) * 3 * big))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_phrase_mining(spark, sf).collect())) == brute(rows, 100)
