"""Collocations: phrases of two to five words that recur, by language, scored and freed of those that a longer one holds.

Count-min sketches over hashes of words, then of pairs of kept words, then of longer phrases all of whose pairs are kept, find
what may be frequent: tasks fill sketches of their own, which are merged by adding cells, and what reaches the least count in
every row of the merged sketch is kept.  A sketch never counts too little, so nothing frequent is lost.  The last pass counts
the kept words and phrases themselves, and Spark adds these exact counts; a hash that misled the sketch costs a row there and
changes no result.

Cells are added up to the least count only, and the merged sketch is one bit a cell: two rows of 2 ** MOST_BITS cells take 128 MB
in a task and 16 MB where they are sent, whatever the size of the corpus.  Beyond 4 GB of text with the same least count cells
fill up, so that more rows reach the exact count, which is a plain distributed aggregation; raise bits or min_count with it.

Defined results.  A null or empty text has no words; a null language is ``und``, as a language of that name is.  Words of any
length are one word.  A long text is taken in blocks that carry over the last four words, so that all its phrases count.  Equal
rows count as often as they come.  Phrases never cross a mark of ``. , ; : ! ?`` or the end of a line.  Of equal cuts the
first counts; equal scores are ordered by frequency, then by the phrase.  An empty table has no phrases.  Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.shared import stash
from lodeseek.operators.lexical import small_or_shuffled

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: A sketch has two rows, each with a cell for so many bytes of text, but from 2 ** LEAST_BITS to 2 ** MOST_BITS of them.
ROWS = 2
BYTES_PER_CELL = 64
LEAST_BITS, MOST_BITS = 16, 26
CHUNK_BITS = 16
#: Bytes of text that a task works on at once.
BLOCK_BYTES = 1 << 21
#: Phrases that a task counts before it hands them on.
HELD = 500_000
#: Splits of the table that a task takes one after the other, where there are more than cores: what they share is added up there.
SPLITS_PER_TASK = 8

BLANK, SEPARATOR = b" ."
WORD_END = re.compile(rb"[ .]")
#: A-Z in lower case, tab as blank and all marks that end a piece as one mark, which no word holds.
CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r",
    b"abcdefghijklmnopqrstuvwxyz " + bytes([SEPARATOR]) * 10,
)
ONCE = np.uint64(0x9E3779B97F4A7C15)
TWICE = np.uint64(0xC2B2AE3D27D4EB4F)

COUNTED = "lang string, k int, phrase binary, f long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * TWICE
    h = (h ^ (h >> np.uint64(29))) * ONCE
    return h ^ (h >> np.uint64(32))


class Block:
    """The words of a stretch of cleaned text: their places, hashes and the piece each is in.

    The first ``skip`` words were in the block before: phrases must end after them."""

    def __init__(self, lang: str, text: bytes, tail: int):
        self.lang, self.text = lang, text
        data = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = (data != BLANK) & (data != SEPARATOR)
        edge = np.diff(inside)
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.skip = int(np.searchsorted(self.start, tail))
        self.piece = np.cumsum(data == SEPARATOR, dtype=np.int32)[self.start]
        self.hashes = self._hashes(data, inside[1:-1], np.uint64(zlib.crc32(lang.encode())))

    def _hashes(self, data: np.ndarray, inside: np.ndarray, salt: np.uint64) -> np.ndarray:
        """Of each word: a polynomial in its bytes, mixed."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        begin = np.zeros(len(data), np.int64)
        begin[self.start] = np.diff(self.start, prepend=0)
        place = np.arange(len(data)) - np.cumsum(begin)
        powers = np.cumprod(np.full(int((self.stop - self.start).max()), TWICE, np.uint64))
        weight = powers[np.minimum(place, len(powers) - 1)] * inside.astype(np.uint64)
        return _mixed(np.add.reduceat((data + np.uint64(1)) * weight, self.start) + salt)

    def phrases(self, k: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the given first words those with a phrase of k words in one piece, and the phrases' hashes."""
        begins = begins[begins + k <= len(self.start)]
        begins = begins[self.piece[begins] == self.piece[begins + k - 1]]
        h = self.hashes[begins]
        for step in range(1, k):
            h = h * ONCE + self.hashes[begins + step]
        return begins, _mixed(h + np.uint64(k))

    def strings(self, k: int, begins: np.ndarray) -> list[bytes]:
        return [self.text[a:b] for a, b in zip(self.start[begins].tolist(), self.stop[begins + k - 1].tolist(), strict=True)]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    for batch in batches:
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            if text.is_valid:
                texts.setdefault(lang, []).append(text.as_py())
        for lang, found in texts.items():
            text = b".".join(found).translate(CLEAN)
            while b"  " in text:
                text = text.replace(b"  ", b" ")
            at, tail = 0, b""
            while at < len(text):
                stop = at + block_bytes
                end = WORD_END.search(text, stop)
                stop = end.start() if end else len(text)
                block = Block(lang, tail + text[at:stop], len(tail))
                yield block
                last = block.start[-LONGEST + 1 :]
                tail = block.text[last[0] :] if len(last) else b""
                at = stop


class Sketch:
    """A count-min sketch of this task, each cell at most ``most``."""

    def __init__(self, bits: int, most: int):
        self.bits, self.most = bits, most
        self.cells = np.zeros((ROWS, 1 << bits), np.min_scalar_type(most))

    def add(self, hashes: np.ndarray) -> None:
        for row in range(ROWS):
            cells, n = np.unique(_cells(hashes, row, self.bits), return_counts=True)
            held = self.cells[row]
            held[cells] = np.minimum(held[cells] + n, self.most)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """The number of each chunk that isn't empty, places in it and their counts."""
        flat = self.cells.reshape(-1)
        size = 1 << min(CHUNK_BITS, self.bits)
        for number, begin in enumerate(range(0, len(flat), size)):
            chunk = flat[begin : begin + size]
            at = np.flatnonzero(chunk)
            if len(at):
                yield number, at.astype(np.uint16).tobytes(), chunk[at].tobytes()


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Each row takes other bits of the hash, multiplied by its own odd number."""
    return ((hashes * (ONCE, TWICE)[row]) >> np.uint64(64 - bits)).astype(np.int64)


class Kept:
    """The merged sketches so far, by order 1, 2 and 3 (which stands for all longer ones): one bit a cell."""

    def __init__(self, bits: int, rows: dict[int, list[bytes]]):
        self.bits = bits
        self.bitmaps = {k: [np.frombuffer(r, np.uint8) for r in found] for k, found in rows.items()}

    def of(self, k: int, hashes: np.ndarray) -> np.ndarray:
        held = np.ones(len(hashes), bool)
        for row, bitmap in enumerate(self.bitmaps[min(k, 3)]):
            cells = _cells(hashes, row, self.bits)
            held &= (bitmap[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
        return held

    def phrases(self, block: Block, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For 1 to last words: begins and hashes of the new phrases all of whose parts are kept.  Only orders that have a
        sketch already are judged themselves."""
        alive, ends = np.ones(len(block.start), bool), {}
        for k in range(1, last + 1):
            begins = np.flatnonzero(alive)
            if k > 1:  # the phrase of k - 1 words here is kept; so must be the last word or, from three words on, the last pair
                begins = begins[begins + k <= len(block.start)]
                size = min(k - 1, 2)
                begins = begins[ends[size][begins + k - size]]
            begins, hashes = block.phrases(k, begins)
            if min(k, 3) in self.bitmaps:
                held = self.of(k, hashes)
                begins, hashes = begins[held], hashes[held]
            new = begins + k > block.skip
            yield k, begins[new], hashes[new]
            alive = np.zeros(len(block.start), bool)
            alive[begins] = True
            ends[k] = alive


def _fill(batches, order: int, longest: int, min_count: int, kept: Kept, bits: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """This task's sketch of words (order 1), pairs (2) or all longer phrases (3)."""
    sketch = Sketch(bits, min_count)
    for block in _blocks(batches, block_bytes):
        for k, _, hashes in kept.phrases(block, longest if order == 3 else order):
            if min(k, 3) == order:
                sketch.add(hashes)
    chunks = sketch.chunks()
    while some := list(itertools.islice(chunks, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "at", "n"])


def _merge(batches, min_count: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Adds the chunks of all tasks; one bit a cell comes out.  A partition holds its own chunks only."""
    kind, sums = np.min_scalar_type(min_count), {}
    size = 1 << min(CHUNK_BITS, bits)
    for batch in batches:
        for number, at, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "at", "n")), strict=True):
            held = sums.setdefault(number, np.zeros(size, kind))
            places = np.frombuffer(at, np.uint16)
            held[places] = np.minimum(held[places].astype(np.int64) + np.frombuffer(n, kind), min_count)
    for number, held in sums.items():
        full = held >= min_count
        if full.any():
            yield pa.RecordBatch.from_pydict({"chunk": [number], "full": [np.packbits(full, bitorder="little").tobytes()]}, pa.schema([("chunk", pa.int32()), ("full", pa.binary())]))


def _sketched(texts: DataFrame, order: int, longest: int, min_count: int, kept: dict[int, list[bytes]], bits: int, block_bytes: int) -> list[bytes]:
    """The merged sketch of an order: ROWS bitmaps of 2 ** bits bits."""
    sent = texts.sparkSession.sparkContext.broadcast(kept)
    filled = texts.mapInArrow(lambda b: _fill(b, order, longest, min_count, Kept(bits, sent.value), bits, block_bytes), "chunk int, at binary, n binary")
    merged = filled.repartition("chunk").mapInArrow(lambda b: _merge(b, min_count, bits), "chunk int, full binary")
    rows = [bytearray(max(1, (1 << bits) >> 3)) for _ in range(ROWS)]
    size = max(1, (1 << min(CHUNK_BITS, bits)) >> 3)
    for number, full in merged.collect():  # 2 ** bits * ROWS / 8 bytes at most
        row, at = divmod(number * size, len(rows[0]))
        rows[row][at : at + size] = full
    sent.unpersist()
    return [bytes(r) for r in rows]


def _count(batches, longest: int, kept: Kept, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Exact counts of kept words and phrases; k = 0 has the number of words.  A task adds up its blocks, HELD phrases at most."""
    counts: Counter = Counter()

    def emitted() -> pa.RecordBatch:
        keys, f = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))] + [pa.array(f, pa.int64())], names=["lang", "k", "phrase", "f"])

    for block in _blocks(batches, block_bytes):
        counts[block.lang, 0, b""] += max(0, len(block.start) - block.skip)
        for k, begins, _ in kept.phrases(block, longest):
            for phrase, n in Counter(block.strings(k, begins)).items():
                counts[block.lang, k, phrase] += n
        if len(counts) > HELD:
            yield emitted()
    if counts:
        yield emitted()


def frequencies(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, bits: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, k, phrase, f: all phrases of 1 to longest words that occur min_count times or more in their language, exactly
    counted, and with k = 0 the number of all its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    splits = texts.rdd.getNumPartitions()
    texts = texts.coalesce(min(splits, max(texts.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS_PER_TASK)))) if splits else texts
    if bits is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        bits = min(max((size // BYTES_PER_CELL).bit_length(), LEAST_BITS), MOST_BITS)
    kept: dict[int, list[bytes]] = {}
    for order in range(1, min(longest, 3) + 1):
        kept[order] = _sketched(texts, order, longest, min_count, kept, bits, block_bytes)
    sent = texts.sparkSession.sparkContext.broadcast(kept)
    counted = texts.mapInArrow(lambda b: _count(b, longest, Kept(bits, sent.value), block_bytes), COUNTED)
    summed = counted.groupBy("lang", "k", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return summed.filter((F.col("k") == 0) | (F.col("f") >= min_count))


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words or more: that of their lowest-scoring cut.

    A frequent part stands in many phrases; these rows are joined as they are, so adaptive execution can split its partition."""
    words = F.split("phrase", " ")
    part = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    cuts = (
        counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"))
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .select("lang", "phrase", "k", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    )
    own = lambda name, f: counts.filter("k > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    totals = small_or_shuffled(counts.filter("k = 0").select("lang", F.col("f").alias("n")))
    exact = "cast(cast(1000 * cast(a as decimal(20,0)) * cast(n as decimal(20,0)) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as long)"
    rated = cuts.join(own("first", "l"), ["lang", "first"]).join(own("rest", "r"), ["lang", "rest"]).join(totals, "lang").withColumn("score", F.expr(exact))
    least = F.min(F.struct("score", "cut", "l", "r")).alias("least")
    return rated.groupBy("lang", "phrase", "k", "a", "n").agg(least).select("lang", "phrase", "k", "a", "least.l", "least.r", "n", "least.score")


def without_parts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """found without phrases that lie in a longer one of counts that is as frequent."""
    words = F.split("phrase", " ")
    parts = (
        counts.filter("k > 2").select("lang", "k", "f", words.alias("words"))
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
        .withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
        .select("lang", F.array_join(F.slice("words", F.col("first"), F.col("size")), " ").alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    return found.join(parts, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def mine(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, bits: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each language's first ``top`` phrases of docs (text, lang): lang, rank, phrase, a, l, r, n, score."""
    counts = stash(frequencies(docs, longest, min_count, bits, block_bytes), "phrases")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(scored(counts), counts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
