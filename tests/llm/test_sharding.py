import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodeseek.llm import sharding


def balanced(found, shards, slack):
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == set(range(shards))
    mean = sum(size.values()) / shards
    assert max(size.values()) <= mean + slack and min(size.values()) >= mean - slack


def test_every_document_once_with_near_equal_bytes(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "repeat('x', cast(pmod(hash(id), 200) as int)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 9)) as source")
    found = sharding.assign_shards(rows, 24).collect()
    assert sorted(r.doc_id for r in found) == list(range(6000))
    balanced(found, 24, 600)


def test_a_third_of_equal_texts_is_split(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('own ', id)) as text", "'s' as source", "'en' as lang")
    balanced(sharding.assign_shards(rows, 7).collect(), 7, 100)


def test_small_fixture(docs, rows):
    found = sharding.assign_shards(docs, 5).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((r[0], len((r[1] or "").encode()) + 8, crc(r[1])) for r in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents_get_the_same_shards_and_keep_their_columns(docs, clashing, rows):
    out = sharding.shard_documents(clashing, 5)
    assert out.columns == [*clashing.drop("shard", "slot").columns, "shard", "slot"]
    a = Counter((r.doc_id, r.shard) for r in out.select("doc_id", "shard").collect())
    assert a == Counter((r.doc_id, r.shard) for r in sharding.assign_shards(docs, 5).collect())


def test_no_python_in_the_plan(docs, capsys):
    sharding.shard_documents(docs, 3).explain()
    assert "Python" not in capsys.readouterr().out


def parted(found):
    """Texts (by digest) of several rows, and those of them in several shards."""
    groups = defaultdict(list)
    for r in found:
        groups[r.text_crc32, r["size"]].append(r.shard)
    several = [g for g in groups.values() if len(g) > 1]
    return len(several), sum(len(set(g)) > 1 for g in several)


def test_equal_rows_are_cut_too(spark):
    rows = spark.range(1800).selectExpr("if(id < 900, 7, id) as doc_id", "if(id < 900, repeat('same ', 100), repeat('x', cast(id % 97 as int))) as text", "'s' as source", "'en' as lang")
    found = sharding.assign_shards(rows, 24).collect()
    balanced(found, 24, 0.05 * sum(r["size"] for r in found) / 24 + 508)
    wide = sharding.shard_documents(rows, 24).selectExpr("*", "octet_length(text) + 8 as size").collect()
    balanced(wide, 24, 0.05 * sum(r["size"] for r in wide) / 24 + 508)
    assert Counter((r.doc_id, r.text) for r in wide) == Counter(map(tuple, rows.select("doc_id", "text").collect()))


def test_light_groups_of_equal_texts_stay_whole(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "concat('text ', id % 15000) as text", "concat('s', id % 7) as source", "concat('l', id % 3) as lang")
    found = sharding.assign_shards(rows, 6).collect()
    several, apart = parted(found)
    assert several == 15_000 and apart == 0
    balanced(found, 6, 0.01 * sum(r["size"] for r in found) / 6)


def test_groups_and_balance_on_the_tables(spark):
    found = sharding.assign_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 24).collect()
    several, apart = parted(found)
    assert several > 40 and apart <= 23  # not more than there are cuts
    balanced(found, 24, 0.1 * sum(r["size"] for r in found) / 24)


def plain_tree(points, shards, first=0):
    """points: keys by dimension, size.  The k-d tree with exact medians in plain Python: shard to its points."""
    if shards == 1:
        return {first: points}
    bits = sharding.TEXT_BITS + sharding.ID_BITS + sharding.ROW_BITS
    widths = [(max(k[d] for k, _ in points) >> bits) - (min(k[d] for k, _ in points) >> bits) for d in range(len(points[0][0]))]
    dim = widths.index(max(widths))
    points = sorted(points, key=lambda p: p[0][dim])
    goal, sums = sum(s for _, s in points) * (shards // 2) / shards, [0]
    for _, s in points:
        sums.append(sums[-1] + s)
    at = min(range(len(sums)), key=lambda i: abs(sums[i] - goal))
    return plain_tree(points[:at], shards // 2, first) | plain_tree(points[at:], shards - shards // 2, first + shards // 2)


def test_equals_a_plain_tree_where_every_row_is_light(spark):
    """With many light texts, none of them twice, shards are those of exact medians but for rows next to a cut."""
    rows = spark.range(30_000).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', pmod(hash(id), 5)) as source", "'en' as lang", "id as row", "octet_length(cast(id as string)) + 8L as size", "xxhash64(cast(id as string)) as text_hash")
    keys = sharding._key_table(rows, sharding.CATEGORIES, ["doc_id"])
    points = [((*r["keys"],), r["size"]) for r in keys.collect()]
    want = {key: shard for shard, members in plain_tree(points, 5).items() for key, _ in members}
    tree = sharding.build_tree(keys, 5, 4)
    got = {(*r["keys"],): r.shard for r in keys.select("keys", tree.shard(F.col("keys")).alias("shard")).collect()}
    assert len(got) == 30_000 and sum(got[k] != want[k] for k in got) <= 0.005 * 30_000


def test_many_shards(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(pmod(hash(id), 50) as int)) || id as text", "'s' as source", "'en' as lang")
    found = sharding.assign_shards(rows, 500).collect()
    balanced(found, 500, 0.2 * sum(r["size"] for r in found) / 500)


def test_empty_table(empty):
    assert sharding.assign_shards(empty, 24).count() == 0
    assert sharding.shard_documents(empty, 4).agg(F.count("*")).first()[0] == 0
