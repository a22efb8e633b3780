"""Line dedup by content-defined chunks of lines.

Each line is hashed, and a rolling hash runs over the last ``WINDOW`` line hashes.  A chunk ends where the
rolling hash leaves 0 when divided by ``MEAN_LINES``: ends depend on the lines near them alone, so that
lines put in or taken out elsewhere don't shift them.  Of chunks of two lines or more that occur more
than once in the corpus, all but the first (least id, then place) are removed.

Hashes only nominate.  The digests that repeat are found by an aggregation that sums per task first; a
bitmap sent to all tasks, of about 16 bits for each of them and ``MOST_BITS`` at most, lets a second reading pass on
the texts of just those chunks (and of few more; of all, should the bitmap be full, with the same result); equality is
then decided on the bytes, as keys of an aggregation that sums per task first as well.  Where all places of a digest
have turned out to hold the same bytes, which is all but always, places are joined by the digest without the bytes,
those of a very common chunk without being dealt by it; digests of several texts are joined with these.

Repeated chunks alone leave the lines of a repeated passage that lie outside its shared chunks, and passages
that share none.  ``remove_repeated_passages`` goes on from the verified chunks line by line: of equal pairs of
neighbouring lines, all but the first are removed as well, found and compared in the same way.  A removed chunk
has an earlier copy, so that pairs inside it can't be first; they are left out, and only what the chunks
didn't settle is read as pairs.  Every line of a passage of two lines or more that came before goes; the
first place of a line stays always.

Defined results: an empty table gives an empty result; very long texts and lines are read whole, one text at a time in
each task; a null text has no lines and stays null; lines end at line feeds and are compared with
all their bytes; a chunk without any word is not removed; rows that agree in id and text are one document,
each keeping what it keeps.  Columns besides id and text are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.shared import join_counted, stash

WINDOW = 2
MEAN_LINES = 4
#: Bits of the bitmap at least, at most, and for each digest.
BITMAP_BITS = 1 << 20
MOST_BITS = 1 << 30
BITS_PER_DIGEST = 16
_MASK = (1 << 64) - 1


def _turned(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _MASK


def chunk_lines(lines: list[bytes], window: int = WINDOW, mean: int = MEAN_LINES) -> list[tuple[int, int]]:
    """First and one past the last line of each chunk."""
    hashes = [xxhash.xxh64_intdigest(line) for line in lines]
    chunks, start, rolling = [], 0, 0
    for at, own in enumerate(hashes):
        rolling = _turned(rolling, 1) ^ own
        if at >= window:
            rolling ^= _turned(hashes[at - window], window)
        if (rolling ^ rolling >> 29) % mean == 0:
            chunks.append((start, at + 1))
            start = at + 1
    if start < len(lines):
        chunks.append((start, len(lines)))
    return chunks


def multi_line_chunks(raw: bytes | None) -> Iterator[tuple[int, bytes]]:
    """(number among all chunks, bytes) of chunks of two lines or more that have a word."""
    for number, _, body in _placed_chunks(raw):
        yield number, body


def _placed_chunks(raw: bytes | None) -> Iterator[tuple[int, int, bytes]]:
    """The same with the first line's number in the middle."""
    if raw is None:
        return
    lines = raw.split(b"\n")
    for number, (a, b) in enumerate(chunk_lines(lines)):
        if b - a > 1:
            body = b"\n".join(lines[a:b])
            if body.strip():
                yield number, a, body


def open_pairs(raw: bytes | None, closed: Callable[[bytes], bool]) -> Iterator[tuple[int, bytes]]:
    """(first line, bytes) of neighbouring lines that have a word and aren't both in one closed chunk."""
    if raw is None or b"\n" not in raw:
        return
    lines = raw.split(b"\n")
    for a, b in chunk_lines(lines):
        inside = b - a > 1 and (body := b"\n".join(lines[a:b])).strip() and closed(body)
        for at in range(b - 1 if inside else a, min(b, len(lines) - 1)):
            body = lines[at] + b"\n" + lines[at + 1]
            if body.strip():
                yield at, body


def _digest(body: bytes) -> int:
    value = xxhash.xxh64_intdigest(body, 1)
    return value - (1 << 64) if value >> 63 else value


BODY_NAMES = ["doc_id", "text_key", "number", "line", "digest", "body"]
BODY_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
BODY_SCHEMA = "doc_id long, text_key long, number int, line int, digest long, body binary"


def _has(bitmap: Broadcast) -> Callable[[int], bool]:
    bits = np.frombuffer(bitmap.value, np.uint8)
    size = 8 * len(bits)  # a power of two
    return lambda digest: bool(bits[digest % size >> 3] >> (digest & 7) & 1)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [_digest(body) for raw in batch["text"] for _, body in multi_line_chunks(raw.as_py())]
        yield pa.record_batch([pa.array(digests, pa.int64())], ["digest"])


def _body_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(BODY_NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, BODY_TYPES, strict=True)], BODY_NAMES)


def _body_batches(bitmap: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = _has(bitmap)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, key, raw in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["text"], strict=True):
                for number, line, body in _placed_chunks(raw.as_py()):
                    digest = _digest(body)
                    if has(digest):
                        rows.append((doc_id, key, number, line, digest, body))
            yield _body_batch(rows)

    return run


def _pair_batches(chunks: Broadcast | None, pairs: Broadcast | None):
    """Pairs of lines, of texts but for the insides of nominated chunks, or if chunks is None, of such chunks' bodies (line:
    where text begins in the document).  Gives digests, or with the pairs' bitmap those in it, numbered by first lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_chunks, in_pairs = chunks and _has(chunks), pairs and _has(pairs)
        closed = (lambda body: in_chunks(_digest(body))) if chunks else (lambda body: False)
        for batch in batches:
            rows: list[tuple] = []
            digests: list[int] = []
            for doc_id, key, line, raw in zip(*(batch[c].to_pylist() for c in ("doc_id", "text_key", "line")), batch["text"], strict=True):
                for at, body in open_pairs(raw.as_py(), closed):
                    digest = _digest(body)
                    if not pairs:
                        digests.append(digest)
                    elif in_pairs(digest):
                        rows.append((doc_id, key, line + at, line + at, digest, body))
            yield _body_batch(rows) if pairs else pa.record_batch([pa.array(digests, pa.int64())], ["digest"])

    return run


def _bitmap(digests: DataFrame) -> bytes:
    """A bit for each digest's remainder."""
    size = min(MOST_BITS, max(BITMAP_BITS, 1 << (BITS_PER_DIGEST * digests.count() - 1).bit_length()))
    place = F.pmod("digest", F.lit(size)).cast("long").alias("place")
    parts = digests.select(place).groupBy((F.col("place") / 32768).cast("int").alias("part")).agg(F.expr("bitmap_construct_agg(place % 32768)").alias("bits"))
    whole = bytearray(size // 8)
    for row in parts.toLocalIterator():
        whole[row.part * 4096 : (row.part + 1) * 4096] = row.bits
    return bytes(whole)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _twice(digests: DataFrame, name: str) -> DataFrame:
    return stash(digests.groupBy("digest").count().filter("count > 1").select("digest"), name)


def _firsts(found: DataFrame) -> DataFrame:
    """Each body with its first place and its number of places."""
    place = F.struct("doc_id", "text_key", "number", "line")
    return found.groupBy("digest", "body").agg(F.min(place).alias("first"), F.count("*").alias("n"))


def _later(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """The places of equal bodies but the first, without the bodies.  Both are written tables."""
    place = F.struct("doc_id", "text_key", "number", "line")
    digests = stash(firsts.groupBy("digest").agg(F.count("*").alias("bodies"), F.max("n").alias("n"), F.first("first").alias("first")), "digests")
    met = join_counted(found.drop("body"), digests.filter("bodies = 1 and n > 1").drop("bodies"), "digest")
    mixed = digests.filter("bodies > 1").select("digest")
    if not mixed.isEmpty():
        several = firsts.filter("n > 1").join(mixed, "digest", "left_semi").select("digest", "body", "first")
        met = met.unionByName(found.join(several, ["digest", "body"]).drop("body"))
    return met.filter(~place.eqNullSafe(F.col("first")))


def _nominated_chunks(rows: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Places and bodies of the chunks in a bitmap of the digests that repeat, and the bitmap."""
    twice = _twice(rows.select("text").mapInArrow(_key_batches, "digest long"), "repeated-digests")
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(twice))
    return stash(rows.mapInArrow(_body_batches(bitmap), BODY_SCHEMA), "nominated-chunks"), bitmap


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and drop, the numbers of chunks to remove, of the documents that have some."""
    found, _ = _nominated_chunks(_texts(docs, id_col, text_col))
    return _later(found, stash(_firsts(found), "first-chunks")).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("number")).alias("drop"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeated_chunks() with drop_pairs, the first lines of pairs to remove that aren't inside of such a chunk."""
    rows = _texts(docs, id_col, text_col)
    found, bitmap = _nominated_chunks(rows)
    firsts = stash(_firsts(found), "first-chunks")
    chunks = _later(found, firsts).select("doc_id", "text_key", F.col("number").alias("chunk"), F.lit(None).cast("int").alias("pair"))
    whole = rows.withColumn("line", F.lit(0))
    inner = firsts.select("first.doc_id", "first.text_key", F.col("body").alias("text"), "first.line")

    def pairs(schema: str, own: Broadcast | None) -> DataFrame:
        return whole.mapInArrow(_pair_batches(bitmap, own), schema).unionByName(inner.mapInArrow(_pair_batches(None, own), schema))

    twice = _twice(pairs("digest long", None), "repeated-pair-digests")
    in_pairs = docs.sparkSession.sparkContext.broadcast(_bitmap(twice))
    met = stash(pairs(BODY_SCHEMA, in_pairs), "nominated-pairs")
    later = _later(met, stash(_firsts(met), "first-pairs")).select("doc_id", "text_key", F.lit(None).cast("int").alias("chunk"), F.col("number").alias("pair"))
    sets = [F.sort_array(F.collect_set(c)).alias(name) for c, name in (("chunk", "drop"), ("pair", "drop_pairs"))]
    return chunks.unionByName(later).groupBy("doc_id", "text_key").agg(*sets)


def _clean_batches(columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stats = [], []
            for raw, drop, pairs in zip(batch[text_col], batch["_drop"].to_pylist(), batch["_drop_pairs"].to_pylist(), strict=True):
                text = raw.as_py()
                if text is None:
                    texts.append(None)
                    stats.append((0, 0, 0, 0))
                    continue
                lines = text.split(b"\n")
                chunks, gone = chunk_lines(lines), set(drop or ())
                out = {line for at in pairs or () for line in (at, at + 1)}
                kept = [lines[at] for number, (a, b) in enumerate(chunks) if number not in gone for at in range(a, b) if at not in out]
                texts.append(b"\n".join(kept))
                stats.append((len(lines), len(chunks), len(gone), len(lines) - len(kept)))
            new = [pa.array(texts, pa.binary()), *(pa.array([s[i] for s in stats], pa.int64()) for i in range(4))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *new], [*columns, "_clean", "_lines", "_chunks", "_gone", "_gone_lines"])

    return run


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, the text without repeated chunks, and _lines, _chunks, _gone (chunks removed)
    and _gone_lines, in place of columns with these names."""
    docs = docs.drop("_lines", "_chunks", "_gone", "_gone_lines")
    return _removed(docs, repeated_chunks(docs, id_col, text_col).withColumn("drop_pairs", F.lit(None).cast("array<int>")), id_col, text_col)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same without all lines of repeated passages of two lines or more; _gone still counts whole chunks."""
    docs = docs.drop("_lines", "_chunks", "_gone", "_gone_lines")
    return _removed(docs, repeated_passages(docs, id_col, text_col), id_col, text_col)


def _removed(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    own = docs.toDF(*plain.values()).withColumn(plain[text_col], F.col(plain[text_col]).cast("binary"))
    drops = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("drop").alias("_drop"), F.col("drop_pairs").alias("_drop_pairs"))
    met = F.col(plain[id_col]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(plain[text_col]) == F.col("_key"))
    rows = own.join(drops, met, "left").select(*own.columns, "_drop", "_drop_pairs")
    kept = [c for c in own.columns if c != plain[text_col]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name in kept)
    stats = "_lines long, _chunks long, _gone long, _gone_lines long"
    cleaned = rows.mapInArrow(_clean_batches(kept, plain[text_col]), f"{schema}{', ' if kept else ''}_clean binary, {stats}")
    back = [F.col("_clean").cast("string").alias(old) if old == text_col else F.col(new).alias(old) for old, new in plain.items()]
    return cleaned.select(*back, "_lines", "_chunks", "_gone", "_gone_lines")
