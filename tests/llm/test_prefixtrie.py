"""The trie of conversations against one built from Python lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeseek.llm import prefixtrie
from lodeseek.llm.queries import op13_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).hexdigest()[:32]
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (*t[:2], key(t)))] for c, turns in own.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, found in members.items():
        if node:
            children[node[:-1]] += 1
    for node, found in members.items():
        gain = (len(found) - 1) * len(re.findall(r"[^ \t-\r]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += not children[node]
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c, last in sorted(found) if last)
        parent = min(members[node[:-1]])[0] if node else None
        out.append((min(found)[0], len(node), parent, len(found), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(trie):
    assert trie.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, trie.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed):
    """Few texts, so that many beginnings meet; heads that are absent or short; a hot conversation and many copies of one."""
    rng = random.Random(seed)
    texts = ["yes", "no no", "", None, "a b\tc", "long " * 500]
    rows = []
    for c in [*range(0, 45), *range(61, 75), -3, -20, -25, 400, 419]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([turn, turn, None, 0]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(7, i, "user", f"t{i % 3}") for i in range(10, 700)]
    rows += [(1000 + i, turn, "user", f"copy {turn}") for i in range(300) for turn in range(5)]
    return [*rows, (None, 0, "user", "yes"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = random_rows(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    table = table.select("*", *(F.lit(1).alias(n) for n in ("depth", "key", "parent", "place", "_part", "n_convs", "way")))
    assert found(prefixtrie.rebuilt_trie(table)) == brute(rows)


def test_chain_and_caterpillar(spark):
    """One conversation that others leave at each of its turns, beside a long one that nobody leaves."""
    rows = [(c, t, "user", f"{t}" if t < c - 2000 else f"{c} left") for c in range(2000, 2030) for t in range(c - 2000 + 1)]
    rows += [(3000, t, "user", "again") for t in range(2000)]
    assert found(prefixtrie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(prefixtrie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    lonely = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lonely, 0, "user", "gone with its head")]
    assert found(prefixtrie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_running_over_cut_groups(spark):
    """Groups that are cut between tasks, and tasks that lie within one group."""
    rows = [(g, i, i % 7, i % 5, bytes([i % 3])) for g, n in ((1, 3), (2, 900), (3, 1), (4, 60)) for i in range(n)]
    table = spark.createDataFrame(rows, "g long, i long, s long, x long, c binary").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefixtrie.running(table, ["g", "i"], {"s": "sum", "x": "xor", "c": "concat"}, "t", "g").collect()
        whole = prefixtrie.running(table, ["g", "i"], {"s": "sum"}, "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, total, sums = [], 0, []
    for g, i, s, x, c in sorted(rows):
        last = want[-1] if want and want[-1][0] == g else (g, 0, 0, 0, b"")
        want.append((g, i, last[2] + s, last[3] ^ x, last[4] + c))
        total += s
        sums.append((g, i, total))
    assert sorted((r.g, r.i, r.s, r.x, bytes(r.c)) for r in got) == want
    assert sorted((r.g, r.i, r.s) for r in whole) == sums


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op13_conversation_trie(spark, sf)) == brute(rows)
