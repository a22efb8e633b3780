from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import components, simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_equal_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    classes = plain_components(prints)
    least = {}
    for r, c in zip(rows, classes, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], p, least.get(c)) for r, p, c in zip(rows, prints, classes, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_one_of_each_group_stays(docs, clashing, rows):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    classes = plain_components([plain_fingerprint(r[1]) for r in rows])
    assert kept.count() == len(set(classes))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=6)), max_size=60))
@settings(max_examples=60, deadline=None)
@pytest.mark.parametrize("large", [4096, 5])
def test_bucket_components_equal_brute_force(large, centres, flips):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "LARGE_BUCKET", large)
        check_bucket(centres, flips)


def check_bucket(centres, flips):
    members = sorted({centres[c % len(centres)] ^ sum(1 << b for b in bits) for c, bits in flips} | set(centres))
    signed = np.array(members, np.uint64).view(np.int64)
    found = simhash.bucket_components(signed, 4)
    parent = {int(x): int(x) for x in signed} | dict(found)
    classes = plain_components(members)
    groups = {}
    for x, c in zip(signed.tolist(), classes, strict=True):
        groups.setdefault(c, []).append(x)
    assert all(parent[x] == min(g) for g in groups.values() for x in g)


def test_result_is_the_same_for_any_number_of_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    prints = {int(x) for x in base}
    for x in base[:20].tolist():
        for _ in range(12):
            x ^= sum(1 << int(b) for b in rng.choice(63, 3, replace=False))
            prints.add(x)
    table = spark.createDataFrame([(x,) for x in prints], "fp long")
    results = []
    for blocks in (5, 6, 7):
        roots = components.connected_components(simhash.close_links(table, 4, blocks))
        results.append(sorted(map(tuple, roots.collect())))
    assert results[0] and results[0] == results[1] == results[2]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5)], "u long, v long")
    got = dict(map(tuple, components.connected_components(links).collect()))
    assert got == {i: 0 for i in range(1, 301)} | {901: 900}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
