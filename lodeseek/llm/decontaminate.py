"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive words of the benchmark items (a shorter item is one
window), the symbols are words, and a block is two of them.  For each pattern length there is a shift
table from blocks to how far the search may move on, and, for blocks that end a pattern, a bucket of
the patterns with that ending, split by their first word.  Most pairs of words occur in no pattern, so
the search looks at about every ninth word; a candidate is compared word by word.

Documents are searched where they lie, without a shuffle.  The pattern tables go to every executor, so
their size is bounded: items are taken in blocks of at most ``BLOCK_BYTES`` of text (one item at least),
and with more than one block the documents get a row number in a written table, each block is searched
in a pass of its own, and the hits of the passes are merged per row.

A Python worker builds the tables once and keeps them from task to task.

Defined results: a null or empty text has no words and no hits, a very long one is searched whole, and an empty table
gives an empty result, with or without items; an item without words matches nothing;
an item with a null id marks words but is not counted among the items; items with equal ids count as
one; repeated documents come back as often as they came; columns besides those named aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.shared import stash

WINDOW = 10
BLOCK_BYTES = 2_000_000
#: A-Z to a-z, digits, a-z and bytes from 128 stay, and all others become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SPANS = "array<struct<start:long,stop:long>>"


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text: runs of ASCII letters, ASCII digits and non-ASCII characters."""
    return raw.translate(WORD_BYTES).split() if raw else []


class _LengthClass:
    """The tables for patterns of one length."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))

    def add(self, item: int, words: list[bytes], at: int) -> None:
        end = at + self.length
        for last in range(at + self.block, end + 1):
            block, rest = tuple(words[last - self.block : last]), end - last
            if rest < self.shift.get(block, self.far):
                self.shift[block] = rest
        self.buckets[tuple(words[end - self.block : end])][words[at]].append((item, at))


class WuManber:
    """Finds windows of items (id, UTF-8 text) in lists of words."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW) -> None:
        self.ids = [i for i, _ in items]
        self.words = [words_of(text) for _, text in items]
        classes: dict[int, _LengthClass] = {}
        for number, words in enumerate(self.words):
            length = min(window, len(words))
            if length:
                own = classes.setdefault(length, _LengthClass(length))
                for at in range(len(words) - length + 1):
                    own.add(number, words, at)
        self.classes = list(classes.values())

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, stop) of occurrences, and the numbers of the items they belong to."""
        spans, found, n = [], set(), len(words)
        for own in self.classes:
            length, far, shift_of, two = own.length, own.far, own.shift.get, own.block == 2
            end = length
            while end <= n:
                block = (words[end - 2], words[end - 1]) if two else (words[end - 1],)
                shift = shift_of(block, far)
                if shift:
                    end += shift
                    continue
                start = end - length
                met = [i for i, at in own.buckets[block].get(words[start], ()) if self.words[i][at : at + length] == words[start:end]] if block in own.buckets else []
                if met:
                    spans.append((start, end))
                    found.update(met)
                end += 1
        return spans, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted spans that neither overlap nor touch."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


_built: dict[tuple[str, int], WuManber] = {}


def _tables(key: str, items: Broadcast, window: int) -> WuManber:
    """The tables of these items (key: a digest of them), which a Python worker keeps from task to task."""
    if (key, window) not in _built:
        _built.clear()
        _built[key, window] = WuManber(items.value, window)
    return _built[key, window]


def _search_batches(key: str, items: Broadcast, window: int, columns: list[str], spans_type: pa.DataType, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, items, window)
        for batch in batches:
            n_words, spans, found, kept = [], [], [], []
            for number, raw in enumerate(batch["_raw"]):
                words = words_of(raw.as_py())
                at, items_met = tables.search(words)
                if only_hits and not at:
                    continue
                kept.append(number)
                n_words.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in merge_spans(at)])
                found.append(sorted({tables.ids[i] for i in items_met if tables.ids[i] is not None}))
            rest = pa.RecordBatch.from_arrays([batch[c] for c in columns], columns).take(pa.array(kept, pa.int64()))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], [*columns, "n_words", "spans", "items"])

    return run


def _search(docs: DataFrame, items: list[tuple[str | None, bytes | None]], text: Column, window: int, only_hits: bool = False) -> DataFrame:
    spark = docs.sparkSession
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    source = docs.withColumn("_raw", text.cast("binary"))
    key = hashlib.sha256(repr(items).encode()).hexdigest()
    run = _search_batches(key, spark.sparkContext.broadcast(items), window, docs.columns, spans_type, only_hits)
    return source.mapInArrow(run, f"{schema}, n_words long, spans {SPANS}, items array<string>")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The named columns of docs (text may be among them) with n_words, spans (word positions covered
    by occurrences, start and stop, merged) and items (ids of items that occur, as sorted strings)."""
    text = F.col("text")
    own = benchmark.select(F.col("item_id").cast("string").alias("id"), text.cast("binary").alias("raw"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes) or 1
    if blocks == 1:
        items = [(r.id, bytes(r.raw) if r.raw else None) for r in own.collect()]  # at most block_bytes of text
        return _search(docs.select(*columns, *([] if "text" in columns else ["text"])), items, text, window).select(*columns, "n_words", "spans", "items")
    numbered = stash(docs.select(*dict.fromkeys([*columns, "text"])).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = []
    for block in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("id", "raw"), F.lit(blocks)) == block).collect()
        items = [(r.id, bytes(r.raw) if r.raw else None) for r in rows]
        hits = _search(numbered.select("_row", "text"), items, text, window, only_hits=True)
        parts.append(stash(hits.select("_row", "spans", "items"), "benchmark-hits"))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = hits.select("_row", _merged(F.array_sort("s")).alias("spans"), "items")
    counted = _search(numbered, [], text, window).drop("spans", "items")
    joined = counted.join(hits, "_row", "left")
    return joined.select(*columns, "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(spans: Column) -> Column:
    """Sorted spans to their union."""
    return F.aggregate(
        spans,
        F.array().cast(SPANS),
        lambda out, x: F.when((F.size(out) > 0) & (x["start"] <= F.element_at(out, -1)["stop"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["stop"], x["stop"]).alias("stop"))))
        ).otherwise(F.concat(out, F.array(x))),
    )


def hit_words(spans: Column) -> Column:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    own = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    found = find_benchmark(docs.toDF(*own.values()), benchmark, list(own.values()))
    return found.filter(F.size("spans") == 0).select(*(F.col(new).alias(old) for old, new in own.items()))


def items_digest(ids: list[str]) -> str:
    """What op3 reports of a list of ids; for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
