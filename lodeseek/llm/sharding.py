"""Sharding by a k-d tree over metadata, with leaves of near-equal bytes.

The root holds all shards.  A node with k shards is cut into nodes with k // 2 and k - k // 2, at the
matching weighted quantile (the median, for even k) of its bytes along its widest dimension, until each
node is one shard.  The dimensions are metadata scaled to the root's range: the id, the logarithm of the
size, and categories by their hash.

Equal texts are one point: all of them have the metadata of the one with the least id, so that a cut goes
around them, unless they weigh more than ``TOLERANCE`` of a shard, and the cut passes right there.  Along a
dimension, rows are ordered by a long key: 18 bits of the scaled value, 18 of a hash of the text, 14 of a
hash of the id and 12 of a number that even equal rows don't share.  So a cut can pass through any number of
rows with equal metadata, a hot source, a large group of copies or of equal rows among them.  Cuts are found
by histograms: all nodes of a level together, each key range in bins whose bytes are summed, and again
inside the bin that the quantile falls into, until a bin is light or holds one key.  What reaches the driver
is some thousand sums a node, ``MOST_SUMS`` in all for 1,000 shards and less, 256 a node beyond.

The passes read a small written table (size, keys); texts take no part.  The tree is kept in three arrays, and
a row walks down them in as many steps as there are levels, so that the plan doesn't grow with the shards.
Slots come from a window per shard and hash bucket over that table, and the buckets' offsets; buckets hold
some hundred thousand rows each, whatever the number of shards.  To write out documents, these are numbered in
a written table, and dealt once by that number to meet their shard and slot.

Defined results: null ids, texts and categories are values of their own (a null text has no bytes, the weight
is 8); very long texts are weighed whole, and one of more than a shard's bytes makes a heavy shard; ties and
repeated rows are cut by their own numbers; an empty table gives an empty result; columns besides those named
stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.shared import join_counted, stash

#: Bytes that a row counts besides its text.
ROW_BYTES = 8
VALUE_BITS, TEXT_BITS, ID_BITS, ROW_BITS = 18, 18, 14, 12
#: Keys that rows of one text share in one dimension, but for the last bits.
GROUP = 1 << (ID_BITS + ROW_BITS)
#: Sums of a pass, and of a node in a pass.
MOST_SUMS, MOST_BINS, LEAST_BINS = 1 << 18, 8192, 256
#: A cut may miss its quantile by a half of this share of a shard, for a group of equal texts to stay whole.
TOLERANCE = 0.005
CATEGORIES = ("source", "lang")
#: Rows of a window.
BUCKET_ROWS = 250_000
LEAST_BUCKETS = 8


@dataclass
class Cut:
    """The search for a node's cut: lo to hi is the range of keys along the widest dimension that still can hold it;
    below: bytes of the node's rows with smaller keys."""

    dim: int
    lo: int
    hi: int
    goal: float
    below: int = 0
    found: int | None = None  # rows with smaller keys go left

    def narrow(self, sums: list[tuple[int, int]], step: int, light: float) -> None:
        """sums: the bytes of the bins of that many keys, from lo on, in order.  Cuts beside the bin that the quantile falls
        into if it is light or one key, else goes on inside."""
        below = self.below
        for at, weight in sums:
            start = self.lo + at * step
            stop = min(start + step - 1, self.hi)
            if below + weight < self.goal:
                below += weight
                continue
            if weight <= light or start == stop:
                self.found = start if self.goal - below < below + weight - self.goal else stop + 1
            else:
                self.lo, self.hi, self.below = start, stop, below
            return
        self.found = self.hi + 1


@dataclass
class Tree:
    """For each node its shards (first and one past the last), and if it is cut, the dimension (else -1), the cut and
    the number of its left child, which the right one follows."""

    shards: list[tuple[int, int]] = field(default_factory=list)
    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    levels: int = 0

    def add(self, first: int, end: int) -> int:
        self.shards.append((first, end))
        for values, x in ((self.dim, -1), (self.cut, 0), (self.left, 0)):
            values.append(x)
        return len(self.shards) - 1

    def node(self, keys: Column) -> Column:
        """The number of the last node on the way of a row with these keys."""
        dim, cut, left = (F.lit(x) for x in (self.dim, self.cut, self.left))

        def step(at: Column, _: Column) -> Column:
            right = (F.get(keys, F.get(dim, at)) >= F.get(cut, at).cast("long")).cast("int")
            return F.when(F.get(dim, at) < 0, at).otherwise(F.get(left, at).cast("int") + right)

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.levels)), F.lit(0), step) if self.levels else F.lit(0)

    def shard(self, keys: Column) -> Column:
        return F.get(F.lit([first for first, _ in self.shards]), self.node(keys)).cast("int")


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _key_table(rows: DataFrame, categories: tuple[str, ...], keep: list[str]) -> DataFrame:
    """rows: a written table with doc_id, size, text_hash, row (its number) and categories.  The columns to keep, with size,
    row and keys: an array with the order along each dimension: doc_id, size, and the categories there are."""
    top = (1 << VALUE_BITS) - 1
    bounds = rows.agg(F.min("doc_id").cast("double").alias("lo"), F.max("doc_id").cast("double").alias("hi")).first()
    lo, hi = bounds.lo or 0.0, bounds.hi or 0.0
    scaled_id = F.coalesce((F.col("doc_id").cast("double") - lo) / max(hi - lo, 1.0), F.lit(0.0))
    scaled_size = F.least(F.log2(F.col("size").cast("double")) / 40, F.lit(1.0))
    values = [F.floor(scaled_id * top), F.floor(scaled_size * top)]
    values += [F.pmod(F.xxhash64(F.col(c).cast("string"), F.lit(c)), F.lit(top + 1)) for c in categories if c in rows.columns]
    point = F.array(*(v.cast("long") for v in values))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", point.alias("point")))
    texts = stash(rows.groupBy("text_hash").agg(least.alias("least"), F.count("*").alias("n")).select("text_hash", "n", F.col("least.point").alias("point")), "shard-points")
    part = lambda c, bits: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    ties = F.shiftleft(part(F.col("text_hash"), TEXT_BITS), ID_BITS + ROW_BITS) + F.shiftleft(part(F.col("doc_id"), ID_BITS), ROW_BITS) + part(F.col("row"), ROW_BITS)
    keys = F.transform("point", lambda v: F.shiftleft(v, TEXT_BITS + ID_BITS + ROW_BITS) + ties).alias("keys")
    return stash(join_counted(rows, texts, "text_hash").select(*keep, "size", "row", keys), "shard-keys")


def _start_cuts(rows: DataFrame, tree: Tree, nodes: list[int], dims: int, light: float) -> dict[int, Cut]:
    """One pass over the rows with a histogram for each node and dimension, by the first bits of the value: choose each
    node's widest dimension and the quantile to look for, and narrow the range down to a bin."""
    bits = next(b for b in range(VALUE_BITS, 0, -1) if len(nodes) * dims << b <= MOST_SUMS or 1 << b <= LEAST_BINS)
    shift = VALUE_BITS - bits + TEXT_BITS + ID_BITS + ROW_BITS
    wanted = F.get(F.lit([int(n in nodes) for n in range(len(tree.dim))]), F.col("node")) == 1
    placed = rows.select(tree.node(F.col("keys")).alias("node"), "keys", "size").filter(wanted)
    bins = placed.select("node", "size", F.posexplode(F.transform("keys", lambda k: F.shiftright(k, shift))).alias("dim", "bin"))
    sums: dict[int, dict[int, list]] = {}
    for row in bins.groupBy("node", "dim", "bin").agg(F.sum("size").alias("size")).collect():
        sums.setdefault(row.node, {}).setdefault(row.dim, []).append((row.bin, row["size"]))
    cuts = {n: Cut(0, 0, 0, 0.0, found=0) for n in nodes}  # nodes without rows
    for n, by_dim in sums.items():
        places = {d: [at for at, _ in found] for d, found in by_dim.items()}
        dim = max(range(dims), key=lambda d: (max(places[d]) - min(places[d]), -d))  # noqa: B023
        first, end = tree.shards[n]
        goal = sum(weight for _, weight in by_dim[dim]) * ((end - first) // 2) / (end - first)
        cuts[n] = Cut(dim, 0, (1 << VALUE_BITS + TEXT_BITS + ID_BITS + ROW_BITS) - 1, goal)
        cuts[n].narrow(sorted(by_dim[dim]), 1 << shift, light)
    return cuts


def _refine(rows: DataFrame, tree: Tree, cuts: dict[int, Cut], light: float) -> None:
    """One pass over the rows: a histogram for each node that has no cut yet."""
    bins = max(LEAST_BINS, min(MOST_BINS, MOST_SUMS // len(cuts)))
    steps = {}
    for n, c in cuts.items():
        step = (c.hi - c.lo) // bins + 1
        steps[n] = step if c.hi - c.lo < GROUP else -(-step // GROUP) * GROUP  # whole groups, but inside of one
    of = lambda get: F.get(F.lit([get(n) if n in cuts else -1 for n in range(len(tree.dim))]), F.col("node")).cast("long")
    placed = rows.select(tree.node(F.col("keys")).alias("node"), "keys", "size").withColumn("dim", of(lambda n: cuts[n].dim)).filter("dim >= 0")
    placed = placed.select("node", "size", F.get("keys", F.col("dim").cast("int")).alias("key"), of(lambda n: cuts[n].lo).alias("lo"), of(lambda n: cuts[n].hi).alias("hi"), of(steps.get).alias("step"))
    sums: dict[int, list] = {}
    for row in placed.filter("key between lo and hi").groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("size")).collect():
        sums.setdefault(row.node, []).append((row.bin, row["size"]))
    for n, c in cuts.items():
        c.narrow(sorted(sums[n]), steps[n], light)


def build_tree(rows: DataFrame, shards: int, dims: int) -> Tree:
    """rows: size and keys of every document."""
    light = TOLERANCE * rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] / shards
    tree = Tree()
    level = [tree.add(0, shards)]
    while level := [n for n in level if tree.shards[n][1] - tree.shards[n][0] > 1]:
        cuts = _start_cuts(rows, tree, level, dims, light)
        while unsettled := {n: c for n, c in cuts.items() if c.found is None}:
            _refine(rows, tree, unsettled, light)
        parts = []
        for n in level:
            first, end = tree.shards[n]
            middle = first + (end - first) // 2
            tree.dim[n], tree.cut[n], tree.left[n] = cuts[n].dim, cuts[n].found, len(tree.shards)
            parts += [tree.add(first, middle), tree.add(middle, end)]
        tree.levels += 1
        level = parts
    return tree


def _with_slots(keys: DataFrame, shards: int) -> DataFrame:
    """keys: a written table with row, keys and shard.  Its columns but for the keys, and slot, 0 to n - 1 within each shard."""
    buckets = max(LEAST_BUCKETS, -(-keys.count() // (shards * BUCKET_ROWS)))
    rows = keys.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").count()
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.get("keys", F.lit(0)), "row"))
    placed = rows.withColumn("inside", inside).drop("keys").join(offsets, ["shard", "bucket"])  # in the window's partitions
    return placed.withColumn("slot", F.col("offset") + F.col("inside") - 1).drop("bucket", "offset", "inside")


def _placed(numbered: DataFrame, shards: int, categories: tuple[str, ...], keep: list[str]) -> DataFrame:
    """The columns to keep of a written table with doc_id, size, text_hash, row and categories, and size, row, shard and slot."""
    own = [c for c in categories if c in numbered.columns]
    keys = _key_table(numbered.select("doc_id", "size", "text_hash", "row", *keep, *own), categories, ["doc_id", *keep])
    tree = build_tree(keys, shards, 2 + len(own))
    return _with_slots(stash(keys.withColumn("shard", tree.shard(F.col("keys"))), "shards"), shards)


def assign_shards(docs: DataFrame, shards: int = 24, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    own = [c for c in categories if c in docs.columns]
    rows = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), crc, *own)
    return _placed(stash(rows, "shard-rows"), shards, categories, ["text_crc32"]).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 24, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The documents with shard and slot, in place of columns with these names."""
    docs = docs.drop("shard", "slot")
    plain = {c: c if c in ("doc_id", "text", *categories) else f"_{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    own = docs.toDF(*plain.values()).select("*", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    numbered = stash(own, "numbered")
    slots = _placed(numbered, shards, categories, []).select("row", "shard", "slot")
    return numbered.join(slots, "row").select(*(F.col(new).alias(old) for old, new in plain.items()), "shard", "slot")
