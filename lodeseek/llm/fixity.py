"""WARC fixity audit with Merkle trees.

Records are laid out in archives: in each archive, in order, with byte offset and length.  A leaf hashes
a record and its range; a node of the tree hashes its ordered children, ``FANOUT`` at most, and the range
they cover.  Above the archives' roots the tree goes on over archives in their order, to one root for the
whole replica.  Two replicas are compared from that root, and only below nodes that differ are children
looked at, so an audit of sound replicas reads one row, and each damaged record one path.

The leaves that differ are then told apart by what they hold: a record with the same bytes elsewhere in the
archive has moved (all behind a record put in or left out do), one whose id has other bytes there is damaged,
one whose id isn't left there is missing, and one that only the replica has is extra.

Native throughout: nodes are aggregations over at most ``FANOUT`` children, each level a written table,
and the descent a chain of joins with the differing nodes of the level above.  Record bytes are hashed
where they are read; layout and trees move digests only.  Archives are hash classes of the records' keys,
as many as hold about ``ARCHIVE_BYTES`` or ``ARCHIVE_RECORDS`` each, so that no window is large.  Or they are WARC
files that ``read_archives`` takes apart (the one function here that runs Python).

Defined results: null ids and urls are written as empty, a null payload as one of no bytes, very long ones whole;
records are ordered by id, then digest, so that rows that agree in all are interchangeable; rows that agree in id
and url share an archive, however many; empty tables have no archives and nothing to report.  Columns besides those
named aren't looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.llm.shared import stash

FANOUT = 16
ARCHIVE_BYTES = 8_000_000
ARCHIVE_RECORDS = 500
END = "\r\n"


def record_bytes(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC resource record, as a string whose UTF-8 bytes are the record."""
    id_, url, payload = (F.coalesce(c.cast("string"), F.lit("")) for c in (id_, url, payload))
    head = ["WARC/1.1", "WARC-Type: resource", F.concat(F.lit("WARC-Record-ID: <urn:page:"), id_, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    lines = [F.lit(x) if isinstance(x, str) else x for x in head]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), payload, F.lit(END + END))


def archive_count(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS) -> int:
    row = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    return max(1, -(-row.bytes // archive_bytes), -(-row.n // archive_records))


def layout(pages: DataFrame, archives: int) -> DataFrame:
    """page_id, archive, place (0 to n - 1 in its archive), start and stop (byte offsets) and digest."""
    record = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"))
    archive = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(archives)).cast("int")
    records = pages.select("page_id", archive.alias("archive"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy("page_id", "digest")
    return records.select(
        "page_id",
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("start"),
        F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"),
        "digest",
    )


def _hashed(start: Column, stop: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws(":", start.cast("string"), stop.cast("string"), content).cast("binary"), 256)


def _parents(children: DataFrame, archive: Column, place: Column) -> DataFrame:
    """One level up: the children of a parent are those with one archive and place there."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("archive", "place", "hash"))), lambda x: x["hash"]), "")
    nodes = children.groupBy(archive.alias("up_archive"), place.alias("up_place")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), listed.alias("content"))
    hashed = _hashed(F.col("start"), F.col("stop"), F.col("content")).alias("hash")
    return stash(nodes.select(F.col("up_archive").alias("archive"), F.col("up_place").alias("place"), "start", "stop", hashed), "merkle")


def _up(level: int, height: int, fanout: int) -> tuple[Column, Column]:
    """The archive and place of the parent of a node on that level, of trees whose archives have so many levels."""
    if level + 1 < height:
        return F.col("archive"), F.expr(f"place div {fanout}")
    return F.expr(f"cast(archive div {fanout} as int)"), F.lit(0).cast("long")


def _levels(widest: int, fanout: int) -> int:
    """Levels of a tree over so many leaves."""
    levels = 1
    while widest > 1:
        widest, levels = -(-widest // fanout), levels + 1
    return levels


def build_tree(records: DataFrame, height: int, archive_levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves over the archives' roots (level height - 1) to the one root: archive, place, start, stop
    and hash.  Trees of one shape have equally many, whatever they hold."""
    levels = [records.select("archive", "place", "start", "stop", _hashed(F.col("start"), F.col("stop"), F.col("digest")).alias("hash"))]
    for level in range(height + archive_levels - 2):
        levels.append(_parents(levels[-1], *_up(level, height, fanout)))
    return levels


def build_trees(layouts: list[DataFrame], fanout: int = FANOUT) -> tuple[list[list[DataFrame]], int]:
    """A tree of each layout, all of one shape, and the number of levels up to the archives' roots."""
    sizes = [x.agg(F.max("place").alias("place"), F.max("archive").alias("archive")).first() for x in layouts]
    height = _levels(max((s.place or 0) + 1 for s in sizes), fanout)
    archive_levels = _levels(max((s.archive or 0) + 1 for s in sizes), fanout)
    return [build_tree(x, height, archive_levels, fanout) for x in layouts], height


def differing_records(ours: list[DataFrame], theirs: list[DataFrame], height: int, fanout: int = FANOUT) -> DataFrame:
    """archive and place of the leaves that differ between two trees of one shape."""
    both = ["archive", "place"]
    frontier = None
    for level in range(len(ours) - 1, -1, -1):
        a, b = ours[level], theirs[level]
        if frontier is not None:
            parents = frontier.select(F.col("archive").alias("pa"), F.col("place").alias("pp"))
            archive, place = _up(level, height, fanout)
            a, b = (x.select("*", archive.alias("ua"), place.alias("up")).join(parents, (F.col("ua") == F.col("pa")) & (F.col("up") == F.col("pp")), "left_semi") for x in (a, b))
        met = a.select(*both, F.col("hash").alias("a")).join(b.select(*both, F.col("hash").alias("b")), both, "full")
        frontier = stash(met.filter(~F.col("a").eqNullSafe(F.col("b"))).select(*both), "differing")
        if frontier.isEmpty():
            return frontier
    return frontier


def compare(own: DataFrame, other: DataFrame) -> DataFrame:
    """own and other: written layouts of two replicas.  The records of own, and those that only other has, with status:
    intact, moved, damaged, missing or extra; archive, place, start and stop are those of the replica that has the record."""
    (ours, theirs), height = build_trees([own, other])
    differ = differing_records(ours, theirs, height)
    a, b = (stash(x.join(differ, ["archive", "place"], "left_semi"), "differing-records") for x in (own, other))
    same, unit = ["archive", "page_id", "digest"], ["archive", "page_id"]
    number = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    equal = F.col("a.archive").eqNullSafe(F.col("b.archive")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.n") == F.col("b.n"))
    sides = [x.withColumn("n", number(same)) for x in (a, b)]
    met = equal & (F.col("a.digest") == F.col("b.digest"))
    left = stash(sides[0].alias("a").join(sides[1].select("archive", "page_id", "digest", "n", F.lit(True).alias("there")).alias("b"), met, "left").select("a.*", "b.there"), "moved")
    alone = [left.filter("there is null"), sides[1].alias("b").join(sides[0].alias("a"), met, "left_anti")]
    rest = [x.drop("n").withColumn("n", number(unit)) for x in alone]  # each damaged record takes one with other bytes
    damaged = rest[0].alias("a").join(rest[1].select("archive", "page_id", "n", F.lit(True).alias("other")).alias("b"), equal, "left")
    columns = own.columns
    told = [
        left.filter("there").select(*columns, F.lit("moved").alias("status")),
        damaged.select(*(f"a.{c}" for c in columns), F.when(F.col("b.other"), "damaged").otherwise("missing").alias("status")),
        rest[1].alias("b").join(rest[0].alias("a"), equal, "left_anti").select(*columns, F.lit("extra").alias("status")),
    ]
    found = own.join(differ, ["archive", "place"], "left_anti").select(*columns, F.lit("intact").alias("status"))
    for part in told:
        found = found.unionByName(part)
    return found.withColumn("intact", F.col("status").isin("intact", "moved"))


def audit(pages: DataFrame, replica: DataFrame, archives: int | None = None) -> DataFrame:
    """compare() for two tables of pages; intact: whether the replica has the record with the same bytes."""
    archives = archives or archive_count(pages)
    return compare(*(stash(layout(x, archives), "layout") for x in (pages, replica)))


# Archives as files.

HEAD_END = re.compile(rb"\r?\n\r?\n")
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
RECORD_ID = re.compile(rb"(?im)^warc-record-id:[ \t]*([^\r\n]*)")


def split_records(raw: bytes) -> Iterator[tuple[str | None, int, int, bytes]]:
    """(record id, start, stop, SHA-256) of the records of a WARC file that isn't compressed.  What can't be read as a record is
    one record without an id, up to the end."""
    at = 0
    while at < len(raw):
        head = HEAD_END.search(raw, at)
        length = LENGTH.search(raw, at, head.start()) if head and raw.startswith(b"WARC/", at) else None
        stop = head.end() + int(length[1]) if length else len(raw)
        stop = min(len(raw), stop)
        while raw[stop : stop + 1] in (b"\r", b"\n"):
            stop += 1
        name = RECORD_ID.search(raw, at, head.start()) if length else None
        yield (name[1].decode("utf-8", "replace") if name else None), at, stop, hashlib.sha256(raw[at:stop]).hexdigest()
        at = stop


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            raw = content.as_py()
            name = path.rsplit("/", 1)[-1].removesuffix(".gz")
            rows = list(split_records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.record_batch(arrays, ["file", "place", "page_id", "start", "stop", "digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path (compressed by gzip or not, each held whole by a task, so 2 GB at most):
    file, place, page_id (the record's id), start, stop and digest, of the bytes that aren't compressed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path)
    return files.select("path", "content").mapInArrow(_record_batches, "file string, place long, page_id string, start long, stop long, digest string")


def audit_archives(spark: SparkSession, path: str, replica_path: str) -> DataFrame:
    """compare() for two folders of WARC files; file names pair the archives.  With the file's name for each record."""
    tables = [stash(read_archives(spark, p), "records") for p in (path, replica_path)]
    names = tables[0].select("file").union(tables[1].select("file")).distinct()
    numbers = stash(names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("int").alias("archive")), "archives")  # a row a file
    own, other = (stash(t.join(F.broadcast(numbers), "file").drop("file"), "layout") for t in tables)
    return compare(own, other).join(F.broadcast(numbers), "archive")
