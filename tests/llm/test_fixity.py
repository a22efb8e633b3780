import gzip
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lodeseek.llm import fixity

SCHEMA = "page_id long, url string, html string"


def pages(spark, count=700):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>é {i} " + "text " * (i % 17)) for i in range(count)]
    return spark.createDataFrame([*rows, (None, None, None), rows[5], rows[5], (count, "u", "")], SCHEMA)


def test_damaged_records_are_located(spark):
    own = pages(spark)
    bad = {3, 77, 400, 401, 699}
    replica = own.withColumn("html", F.when(F.col("page_id").isin(*bad), F.translate("html", "p", "q")).otherwise(F.col("html")))
    found = fixity.audit(own, replica, archives=3).collect()
    assert len(found) == own.count()
    assert {r.page_id for r in found if not r.intact} == bad
    assert all(r.intact for r in fixity.audit(own, own, archives=3).collect())


def test_ranges_and_digests_are_those_of_the_bytes(spark):
    found = fixity.layout(pages(spark, 40), 2).collect()
    raw = {r.digest: r.record for r in pages(spark, 40).select(fixity.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record")).withColumn("digest", F.sha2(F.col("record").cast("binary"), 256)).collect()}
    for archive in {r.archive for r in found}:
        at = 0
        for place, r in enumerate(sorted((r for r in found if r.archive == archive), key=lambda r: r.place)):
            assert (r.place, r.start, r.stop - r.start) == (place, at, len(raw[r.digest].encode()))
            assert hashlib.sha256(raw[r.digest].encode()).hexdigest() == r.digest
            at = r.stop


def test_only_differing_branches_are_descended(spark):
    own = fixity.layout(pages(spark), 20)
    (levels, same), height = fixity.build_trees([own, own])
    assert height == 3 and len(levels) == 5 and levels[2].count() == 20 and levels[3].count() == 2 and levels[4].count() == 1
    assert fixity.differing_records(levels, same, height).count() == 0


def plain_root(records, fanout=fixity.FANOUT):
    """records: archive, place, start, stop, digest.  The one root by hashlib alone."""
    hashed = lambda start, stop, content: (start, stop, hashlib.sha256(f"{start}:{stop}:{content}".encode()).hexdigest())
    up = lambda nodes: [hashed(min(n[0] for n in g), max(n[1] for n in g), "".join(n[2] for n in g)) for g in (nodes[i : i + fanout] for i in range(0, len(nodes), fanout))]
    roots = {}
    for archive in {r[0] for r in records}:
        roots[archive] = [hashed(*r[2:]) for r in sorted(records) if r[0] == archive]
    while max(map(len, roots.values())) > 1:
        roots = {k: up(v) for k, v in roots.items()}
    nodes = [v[0] for _, v in sorted(roots.items())]
    while len(nodes) > 1:
        nodes = up(nodes)
    return nodes[0]


def test_the_root_equals_that_of_plain_python(spark):
    own = fixity.layout(pages(spark, 300), 17).cache()
    ((*_, root), _), _ = fixity.build_trees([own, own])
    r = root.first()
    assert (r.start, r.stop, r.hash) == plain_root([(x.archive, x.place, x.start, x.stop, x.digest) for x in own.collect()])


def test_missing_additional_and_moved_records(spark):
    own = pages(spark, 60)
    less = own.filter("page_id is null or page_id < 58")
    found = fixity.audit(own, less, archives=1).collect()
    assert len(found) == own.count() and {r.page_id: r.status for r in found if not r.intact} == dict.fromkeys((58, 59, 60), "missing")
    found = fixity.audit(less, own, archives=1).collect()
    assert len(found) == own.count() and {r.page_id: r.status for r in found if r.status != "intact"} == dict.fromkeys((58, 59, 60), "extra")
    none = fixity.audit(own, own.limit(0), archives=2).collect()
    assert len(none) == own.count() and {r.status for r in none} == {"missing"}


def test_a_record_put_in_front_moves_the_others_and_damages_none(spark):
    own = pages(spark, 50).filter("page_id is not null")
    replica = own.unionByName(spark.createDataFrame([(-1, "u", "new")], SCHEMA)).withColumn("html", F.when(F.col("page_id") == 20, "changed").otherwise(F.col("html")))
    found = fixity.audit(own, replica, archives=1).collect()
    assert Counter(r.status for r in found) == {"moved": own.count() - 1, "damaged": 1, "extra": 1}
    assert {r.page_id for r in found if not r.intact} == {-1, 20}


def test_repeated_records_are_counted(spark):
    own = spark.createDataFrame([(1, "u", "a")] * 5 + [(1, "u", "b")] * 2, SCHEMA)
    replica = spark.createDataFrame([(1, "u", "a")] * 3 + [(1, "u", "c")] * 3 + [(1, "u", "b")], SCHEMA)
    found = Counter(r.status for r in fixity.audit(own, replica, archives=1).collect())
    assert found["damaged"] == 3 and found["intact"] + found["moved"] == 4 and found["extra"] == found["missing"] == 0


def test_warc_files(spark, tmp_path):
    """Files written by hand, compressed and not: ranges are those of the bytes; a flipped bit, a record too many and a torn end."""
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [f"body {i} \r\n\r\n".encode() * (i % 5) for i in range(60)]
    for side in ("a", "b"):
        (tmp_path / side).mkdir()
        for file in range(3):
            own = [record(i, b"broken" if side == "b" and i == 31 else body) for i, body in enumerate(bodies) if i % 3 == file]
            own += [record(99, b"late")] if side == "b" and file == 2 else []
            raw = b"".join(own)
            raw = raw[:-20] if side == "b" and file == 0 else raw
            (tmp_path / side / f"f{file}.warc{'.gz' if file == 1 else ''}").write_bytes(gzip.compress(raw) if file == 1 else raw)
    first = (tmp_path / "a" / "f0.warc").read_bytes()
    for r in fixity.read_archives(spark, str(tmp_path / "a")).filter("file = 'f0.warc'").collect():
        assert hashlib.sha256(first[r.start : r.stop]).hexdigest() == r.digest and r.page_id == f"<urn:page:{3 * r.place}>"
    found = fixity.audit_archives(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert {(r.page_id, r.file, r.status) for r in found if not r.intact} == {("<urn:page:31>", "f1.warc", "damaged"), ("<urn:page:99>", "f2.warc", "extra"), ("<urn:page:57>", "f0.warc", "damaged")}
    assert sum(r.intact for r in found) == 58


def test_no_python_in_the_plan(spark, capsys):
    fixity.audit(pages(spark, 30), pages(spark, 30)).explain()
    assert "Python" not in capsys.readouterr().out


def test_empty_and_clashing(spark):
    own = pages(spark, 20)
    wide = own.select("*", *(F.lit(1).alias(c) for c in ("archive", "place", "start", "digest", "hash")))
    assert Counter(r.page_id for r in fixity.audit(wide, wide).collect()) == Counter(r.page_id for r in own.collect())
    assert fixity.audit(own.limit(0), own.limit(0)).count() == 0
