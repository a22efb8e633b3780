"""The trie of conversations: which beginnings they share, and how many tokens a cache of beginnings would save.

A node is a distinct sequence of first turns.  Nodes are ranked lexicographically, each subtree is then an interval of ranks from its
top to the end that is stored with it, and leaves and savings of a subtree are differences of prefix sums over the ranks.

No conversation, node or subtree is ever gathered in a task.  Running values (the place of a turn in its conversation, the key of
a beginning, the way to a node, the sums over ranks) come from ``running``: rows are sorted by range, so that a long conversation is
cut between tasks, each task adds up its own rows, and what the tasks before it hold, one row a task, is added afterwards.  The key
of a beginning is the exclusive or of digests of place and turn; the aggregation into nodes checks that all beginnings of a
key have one last turn after one shorter beginning, so by induction they are equal, and fails otherwise.  Ranks follow the digests
of turns, at branching nodes only: a node's way has one digest for each branch on it, so a turn that has no
sibling costs nothing.  Ways get long, and the job dear, only where very many conversations leave a single one at different turns.

The members that end in a node are hashed in ascending order by one task that holds the hash and nothing else, as SHA-256 has no
parts that could be joined.

Defined results.  Null role or text is empty.  Turns are ordered by their number, null first; equal numbers by a digest of role and
text; equal turns are turns of their own.  Rows without a conv_id belong to no conversation.  Texts of any length enter as digests
and word counts only.  A remainder of a negative conv_id has its sign.  A rebuilt conversation without turns ends in the root.  A
table without conversations has no nodes.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from lodeseek.llm.shared import join_counted, stash

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4
ROOT = bytes(15)
#: Bytes of a key, and of each branch of a way.
KEY_BYTES = 15


def _segments(values: np.ndarray | None, begins: np.ndarray, carry, op: str) -> np.ndarray:
    """Running values that start anew at each of begins; carry goes on into the rows before the first of them."""
    ufunc = np.add if op == "sum" else np.bitwise_xor
    total = ufunc.accumulate(values)
    before = np.zeros(len(values), np.int64)
    before[begins] = np.where(begins > 0, total[begins - 1], 0)
    at = np.zeros(len(values), np.int64)
    at[begins] = begins
    at = np.maximum.accumulate(at)
    out = total - before[at] if op == "sum" else total ^ before[at]
    head = len(values) if not len(begins) else begins[0]
    out[:head] = total[:head] + carry if op == "sum" else total[:head] ^ carry
    return out


def _accumulate(batches: Iterator[pa.RecordBatch], group: str | None, ops: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Running values within this task; _part is its number, and _open tells rows of the group that it began with."""
    part, last, opened = TaskContext.get().partitionId(), None, None
    carry = {name: b"" if op == "concat" else 0 for name, op in ops.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        names, columns = list(batch.schema.names), list(batch.columns)
        ids = batch.column(group).to_numpy() if group else np.zeros(batch.num_rows, np.int64)
        change = np.empty(len(ids), bool)
        change[1:] = ids[1:] != ids[:-1]
        change[0] = last is not None and ids[0] != last
        begins = np.flatnonzero(change)
        opened = ids[0] if opened is None else opened
        for name, op in ops.items():
            values = batch.column(name)
            if op == "concat":
                out, held = [], carry[name]
                for new, value in zip(change, values.to_pylist(), strict=True):
                    held = value if new else held + value
                    out.append(held)
                carry[name] = held
                columns[names.index(name)] = pa.array(out, pa.binary())
            else:
                summed = _segments(values.to_numpy(), begins, carry[name], op)
                carry[name] = summed[-1]
                columns[names.index(name)] = pa.array(summed, pa.int64())
        last = ids[-1]
        columns += [pa.array(np.full(len(ids), part, np.int32)), pa.array(ids == opened)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_open"])


def running(rows: DataFrame, order: list[str], ops: dict[str, str], name: str, group: str | None = None) -> DataFrame:
    """rows, written, with running values (sum, xor or concat; in place of the columns that ops names) in the given order, within
    each group or over all rows.  group must be a long and the first of order."""
    fields = [f for f in rows.schema if f.name not in ops]
    fields += [StructField(c, BinaryType() if op == "concat" else LongType()) for c, op in ops.items()]
    schema = StructType([*fields, StructField("_part", IntegerType()), StructField("_open", BooleanType())])
    ordered = rows.select(*(f.name for f in fields)).repartitionByRange(*order).sortWithinPartitions(*order)
    local = stash(ordered.mapInArrow(lambda batches: _accumulate(batches, group, ops), schema), name)
    # the last row of each task, one row a task
    latest = F.max_by(F.struct(*([group] if group else []), *ops), F.struct(*order)).alias("last")
    first = F.min(F.col("_open")).alias("one_group")
    carried, held, of = [], {c: b"" if op == "concat" else 0 for c, op in ops.items()}, None
    opens = {r._part: r.id for r in local.filter("_open").groupBy("_part").agg(F.first(group).alias("id")).collect()} if group else {}
    for row in local.groupBy("_part").agg(latest, first).orderBy("_part").collect():
        if group and opens[row._part] != of:
            held = {c: b"" if op == "concat" else 0 for c, op in ops.items()}
        carried.append((row._part, *held.values()))
        for c, op in ops.items():
            value = row.last[c]
            if not row.one_group:
                held = {**held, c: value}
            else:
                held = {**held, c: held[c] ^ value if op == "xor" else held[c] + value}
        of = row.last[group] if group else None
    kinds = ", ".join(f"`+{c}` {'binary' if op == 'concat' else 'long'}" for c, op in ops.items())
    sent = F.broadcast(rows.sparkSession.createDataFrame(carried, f"_part int, {kinds}"))

    def whole(c: str, op: str) -> Column:
        more = F.col(f"`+{c}`")
        joined = F.concat(more, c) if op == "concat" else more.bitwiseXOR(F.col(c)) if op == "xor" else more + F.col(c)
        return F.when(F.col("_open"), joined).otherwise(F.col(c)).alias(c)

    return local.join(sent, "_part").select(*(f.name for f in rows.schema if f.name not in ops), *(whole(c, op) for c, op in ops.items()))


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_key, words: the turns as they stand, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("place")
    )
    return running(turns, ["conv_id", "turn", "turn_key"], {"place": "sum"}, "turns", "conv_id").drop("turn")


def rebuilt_turns(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of conversations after their first ones are exchanged for those of the family's head, and for each conversation
    the number of its rebuilt turns (total)."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    counted = stash(own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", base.alias("base"), taken.alias("h")), "conversations")
    heads = counted.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    lent = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    sized = counted.join(heads, "base", "left").select("conv_id", "n", "base", "h", lent.alias("lent"))
    sized = stash(sized.withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    after = join_counted(own, sized, "conv_id", "n").filter(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "turn_key", "words")
    first = own.filter((F.col("place") < HEADS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "turn_key", "words")
    borrowed = sized.join(first, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "turn_key", "words")
    return after.unionByName(borrowed), sized.select("conv_id", "total")


def _key(high: Column, low: Column) -> Column:
    """15 bytes of two numbers of 60 bits."""
    return F.unhex(F.concat(*(F.lpad(F.lower(F.hex(c)), 15, "0") for c in (high, low))))


def beginnings(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, turn_key, words: every beginning of every conversation, but for the empty one."""
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("turn_key")).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    own = turns.select("conv_id", "depth", "turn_key", "words", number(1).alias("own_a"), number(17).alias("own_b"))
    keyed = running(own.select("*", F.col("own_a").alias("a"), F.col("own_b").alias("b")), ["conv_id", "depth"], {"a": "xor", "b": "xor"}, "beginnings", "conv_id")
    a, b = F.col("a"), F.col("b")
    return keyed.select("conv_id", "depth", _key(a, b).alias("key"), _key(a.bitwiseXOR(F.col("own_a")), b.bitwiseXOR(F.col("own_b"))).alias("parent"), "turn_key", "words")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, which come one after the other."""
    key, state = None, None
    for batch in batches:
        found: list[tuple[bytes, str]] = []
        for now, id in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if now != key:
                if state:
                    found.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256(b"%d" % id)
            else:
                state.update(b",%d" % id)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.string()), strict=True)], names=["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, without gaps), turn_key (a digest), words.  lengths: conv_id, total (its turns), one row for each conversation."""
    rows = stash(beginnings(turns), "rows")
    same = F.struct("parent", "depth", "turn_key", "words")
    nodes = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(same).alias("is"), F.max(same).alias("also"))
    proved = F.when(F.col("is") != F.col("also"), F.raise_error(F.lit("two beginnings have one key"))).otherwise(F.col("n_convs"))
    nodes = nodes.select("key", "conv_id", "is.depth", "is.parent", proved.cast("long").alias("n_convs"), "is.words")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("words")))
    nodes = stash(nodes, "nodes")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stash(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # each node's parent: of hot parents the row goes to the children
    above = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("branch"), "n_children")
    below = join_counted(nodes.filter("depth > 0"), above.withColumnRenamed("n_children", "_n"), "parent", "_n")
    linked = stash(below.unionByName(nodes.filter("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(False).alias("branch"))), "linked")

    # the way to each node: the keys of those nodes on it that have siblings
    known = linked.filter("depth > 0").select("key", F.col("conv_id").alias("smallest"), "branch", F.col("n_convs").alias("_n"))
    on_path = join_counted(rows.select("conv_id", "depth", "key"), known, "key", "_n").filter(F.col("branch") | (F.col("conv_id") == F.col("smallest")))
    steps = on_path.select("conv_id", "depth", "key", "smallest", F.when(F.col("branch"), F.col("key")).otherwise(F.lit(b"")).alias("way"))
    ways = running(steps, ["conv_id", "depth"], {"way": "concat"}, "ways", "conv_id").filter(F.col("conv_id") == F.col("smallest")).select("key", "way")
    placed = linked.join(ways, "key", "left").withColumn("way", F.coalesce("way", F.lit(b"")))

    # ranks and prefix sums over them
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    ranked = placed.select("*", leaf.alias("leaf"), saved.alias("saved"), F.lit(1).cast("long").alias("rank"), leaf.alias("leaves"), saved.alias("savings"))
    ranked = stash(running(ranked, ["way", "depth"], {"rank": "sum", "leaves": "sum", "savings": "sum"}, "ranks"), "ranked")

    # the end of each subtree: the highest rank of all ways that begin as its own
    runs = ranked.groupBy("way").agg(F.max(F.struct("rank", "leaves", "savings")).alias("end"))
    steps_on = F.sequence(F.lit(0), F.floor(F.octet_length("way") / KEY_BYTES).cast("int"))
    ends = runs.select(F.explode(steps_on).alias("step"), "way", "end").groupBy(F.substring("way", F.lit(1), F.col("step") * KEY_BYTES).alias("way")).agg(F.max("end").alias("end"))
    ends = stash(ends.join(ranked.groupBy("way").agg(F.count("*").alias("_n")), "way"), "ends")
    whole = join_counted(ranked, ends, "way", "_n")

    last = rows.join(lengths.select("conv_id", F.col("total").alias("depth")), ["conv_id", "depth"], "left_semi").select("key", "conv_id")
    last = last.unionByName(lengths.filter("total = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    digests = last.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "key binary, ends_sha256 string")
    return whole.join(digests, "key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("end.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end.savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) with the exchanged first turns."""
    return trie(*rebuilt_turns(own_turns(conversations)))
