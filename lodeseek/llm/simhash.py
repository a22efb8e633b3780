"""SimHash near-duplicates: pigeonhole blocks find the close pairs of fingerprints.

A fingerprint has 64 bits.  Cut into ``blocks`` blocks, two fingerprints that differ in at most
``distance`` bits agree on at least ``blocks - distance`` whole blocks.  There is one table for each
choice of that many blocks; fingerprints that agree on the blocks of a table meet in one of its
buckets, where the Hamming distance decides.  More blocks make more tables and smaller buckets; the
number is chosen from the count of distinct fingerprints, and the result is the same for any.

Only distinct fingerprints take part, so a group of exact copies, however large, is one row.
Inside a bucket the links are searched breadth first among the fingerprints not yet reached, and a
bucket gives one row for each member of a component (member, smallest member) rather than all pairs.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and link
like any other; very long texts are hashed whole; repeated rows come back as often as they came; a null id never is a component's name,
a component whose ids are all null has a null one; columns besides id and text are not looked at, so
their names cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.components import connected_components
from lodeseek.llm.shared import join_counted, stash

BITS = 64
#: A fingerprint may be compared with so many others that it meets by mere chance, over all tables: comparing is one
#: exclusive or, and a table more is a row more to shuffle.
CHANCE_PER_FINGERPRINT = 200
#: A bucket of more distinct fingerprints is cut into smaller ones.
LARGE_BUCKET = 4096
#: Hash values whose bits are counted at once.
SLAB = 1 << 15


def fingerprint(raw: bytes | None, shingle: int = 4) -> int:
    """The SimHash of UTF-8 text, unsigned: A-Z lowered, words split at ASCII white space, shingles of
    so many words with repeats (or all words, if fewer); a bit is set if over half the shingles set it."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(text, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    count = len(starts)
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.dtype("<u8"), count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, SLAB):
        slab = hashes[at : at + SLAB]
        ones += np.unpackbits(slab.view(np.uint8), bitorder="little").reshape(len(slab), BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch["text"]), np.uint64, batch.num_rows)
            yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, text_key (a hash of the text, to find a row again) and fp (the fingerprint, as a signed long)."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), "doc_id long, text_key long, fp long")


def block_count(distinct: int, distance: int) -> int:
    """The fewest blocks, two or more of which agree, with which chance meetings stay under CHANCE_PER_FINGERPRINT: with a
    distance of 4, six (15 tables) to a hundred million fingerprints, eight (70) at ten thousand million."""
    for blocks in range(distance + 2, 2 * distance + 4):
        key_bits = BITS * (blocks - distance) / blocks
        if distinct * comb(blocks, distance) / 2**key_bits <= CHANCE_PER_FINGERPRINT:
            return blocks
    return 2 * distance + 4


def table_masks(blocks: int, distance: int) -> list[int]:
    """A mask for each table, as a signed long: ones over the blocks that have to agree."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(parts[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _reach(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Breadth-first search among sorted members; each step looks at those not reached yet."""
    left, found = members, []
    while left.size > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and left.size:
            near = _apart(left, np.int64(frontier.pop())) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                frontier.extend(reached.tolist())
                found.extend((x, int(root)) for x in reached.tolist())
    return found


def bucket_components(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for each member but the smallest; members: distinct.

    A bucket of over LARGE_BUCKET is cut again: close members share one of distance + 1 blocks of the bits
    that vary in it, and what the smaller buckets of all blocks connect is connected."""
    members = np.sort(members)
    if members.size <= LARGE_BUCKET:
        return _reach(members, distance)
    varying = int(np.bitwise_or.reduce((members ^ members[0]).view(np.uint64)))
    bits = [bit for bit in range(BITS) if varying >> bit & 1]
    if len(bits) <= distance:
        return [(x, int(members[0])) for x in members[1:].tolist()]
    parent = {x: x for x in members.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for part in range(distance + 1):
        mask = np.uint64(sum(1 << bit for bit in bits[part :: distance + 1]))
        key = members.view(np.uint64) & mask
        order = np.argsort(key, kind="stable")
        runs = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]))
        for start, stop in zip(runs[:-1], runs[1:], strict=True):
            if stop - start > 1:
                for u, v in bucket_components(members[order[start:stop]], distance):
                    low, high = sorted((root(u), root(v)))
                    parent[high] = low
    return [(x, root(x)) for x in parent if root(x) != x]


def _bucket_links(masks: list[int], distance: int):
    """Rows come sorted by table and key; a bucket may go over the end of a batch."""
    lookup = np.array(masks, np.int64)

    def links_of(table: np.ndarray, fp: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(runs)
        twos = runs[:-1][sizes == 2]
        twos = twos[_apart(fp[twos], fp[twos + 1]) <= distance]
        low, high = np.minimum(fp[twos], fp[twos + 1]), np.maximum(fp[twos], fp[twos + 1])
        more = [pair for i in np.flatnonzero(sizes > 2) for pair in bucket_components(fp[runs[i] : runs[i + 1]], distance)]
        u, v = (np.array(x, np.int64) for x in zip(*more, strict=True)) if more else (np.array([], np.int64),) * 2
        return pa.record_batch([pa.array(np.concatenate((high, u))), pa.array(np.concatenate((low, v)))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            table, fp = batch["t"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            key = fp & lookup[table]
            starts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            if waiting and (waiting[-1][0][-1] != table[0] or waiting[-1][1][-1] & lookup[table[0]] != key[0]):
                starts = np.concatenate(([0], starts))
            if not len(starts):
                waiting.append((table, fp))
                continue
            done = starts[-1]
            table_done = np.concatenate([x[0] for x in waiting] + [table[:done]])
            fp_done = np.concatenate([x[1] for x in waiting] + [fp[:done]])
            before = len(table_done) - done
            first = [] if starts[0] + before == 0 else [0]
            yield links_of(table_done, fp_done, np.concatenate((first, starts + before)).astype(np.int64))
            waiting = [(table[done:], fp[done:])]
        if waiting:
            table_done, fp_done = (np.concatenate([x[i] for x in waiting]) for i in (0, 1))
            yield links_of(table_done, fp_done, np.array([0, len(fp_done)]))

    return run


def close_links(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """distinct: a column fp without repeats.  Returns u and v such that the components of these links
    are those of all pairs at most so many bits apart."""
    blocks = blocks or block_count(distinct.count(), distance)
    masks = table_masks(blocks, distance)
    tables = F.array(*[F.lit(m) for m in masks])
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("t"), "fp")
    key = F.col("fp").bitwiseAND(F.element_at(tables, F.col("t") + 1))
    rows = rows.repartition(F.col("t"), key).sortWithinPartitions("t", key)
    return rows.mapInArrow(_bucket_links(masks, distance), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, text_key, fp, root (the smallest fingerprint reachable over links) and component_id (the
    smallest id reachable) for every row."""
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(close_links(classes.select("fp"), distance))
    rooted = stash(classes.join(roots, classes.fp == roots.u, "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    names = stash(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("members")), "components")
    named = stash(join_counted(rooted, names, "root", "members").select("fp", "root", "component_id", "n"), "named")
    return join_counted(prints, named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component: that named by component_id, or where no row has an id that with the
    smallest text_key."""
    plain = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    keys = lambda id_, text_key: (F.coalesce(id_, F.lit(0)).alias("_id"), id_.isNull().alias("_no_id"), text_key.alias("_key"))
    own = docs.toDF(*plain.values()).select("*", *keys(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("binary"))))
    found = near_duplicates(docs, shingle=shingle, distance=distance)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    kept = found.groupBy("root").agg(F.min(first).alias("one")).select(*keys(F.col("one.doc_id"), F.col("one.text_key")))
    met = own.join(kept, ["_id", "_no_id", "_key"], "left_semi")  # the join's partitioning serves the next line too
    return met.dropDuplicates(["_id", "_no_id", "_key"]).select(*(F.col(new).alias(old) for old, new in plain.items()))
