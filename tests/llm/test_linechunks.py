from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import linechunks as lc


def plain_clean(rows):
    """Equal rows are one document."""
    places = {}
    for key in dict.fromkeys((r[0], r[1]) for r in rows):
        if key[1] is not None:
            for number, body in lc.multi_line_chunks(key[1].encode()):
                places.setdefault(body, []).append((key, number))
    out = {}
    for key in dict.fromkeys((r[0], r[1]) for r in rows):
        if key[1] is None:
            out[key] = None
            continue
        lines = key[1].split("\n")
        chunks = lc.chunk_lines([line.encode() for line in lines])
        gone = set()
        for body, where in places.items():
            first = min(where, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1])) if len({w[0][0] for w in where}) > 1 else None
            for k, number in where:
                if k == key:
                    gone.add((number, body, first))
        drop = {n for n, body, first in gone if (key, n) != _first(places[body])}
        out[key] = "\n".join(line for n, (a, b) in enumerate(chunks) if n not in drop for line in lines[a:b])
    return out


def _first(where):
    return min(where, key=lambda x: (x[0][0] is not None, x[0][0] or 0, _text_key(x[0][1]), x[1]))


def _text_key(text):
    import xxhash

    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - 2**64 if value >> 63 else value


def test_equals_brute_force(docs, rows):
    want = plain_clean(rows)
    got = lc.remove_repeated_chunks(docs).collect()
    assert len(got) == len(rows)
    before = Counter((r[0], None if r[1] is None else len(r[1].split("\n"))) for r in rows)
    assert before == Counter((r.doc_id, None if r.text is None else r._lines) for r in got)
    assert Counter((k[0], want[k]) for k in ((r[0], r[1]) for r in rows)) == Counter((r.doc_id, r.text) for r in got)
    assert any(r._gone for r in got)


def test_chunks_resist_shifts():
    lines = [f"line {i * i % 101} of {i}".encode() for i in range(200)]
    body = lambda ls: {tuple(ls[a:b]) for a, b in lc.chunk_lines(ls)}
    for at in (0, 57, 130):
        shifted = lines[:at] + [b"put in"] + lines[at:]
        assert len(body(lines) - body(shifted)) <= 3
    chunks = lc.chunk_lines(lines)
    assert chunks[0][0] == 0 and chunks[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:], strict=False))
    assert lc.chunk_lines([]) == []


def test_equal_hashes_do_not_make_equal_chunks(spark):
    """Places with one digest and three bodies: the bytes decide."""
    bodies = {1: b"a\nb", 2: b"c\nd", 3: b"a\nb", 4: b"c\nd", 5: b"e\nf", 6: b"a\nb"}
    found = spark.createDataFrame([(i, i, 0, 0, 77, x) for i, x in bodies.items()] + [(i, i, 0, 5, 78, b"g\nh") for i in (8, 9)], lc.BODY_SCHEMA)
    later = lc._later(found, lc._firsts(found)).collect()
    assert sorted((r.doc_id, r.digest) for r in later) == [(3, 77), (4, 77), (6, 77), (9, 78)]


def plain_chunks(lines):
    """Ends by the definition: the xor of the last two lines' hashes, the earlier one turned by a bit."""
    import xxhash

    turned = lambda x, k: (x << k | x >> (64 - k)) % 2**64 if k else x
    hashes = [xxhash.xxh64(x).intdigest() for x in lines]
    chunks, start = [], 0
    for at in range(len(lines)):
        value = 0
        for back in range(lc.WINDOW):
            value ^= turned(hashes[at - back], back) if at >= back else 0
        if (value ^ value >> 29) % lc.MEAN_LINES == 0 or at == len(lines) - 1:
            chunks.append((start, at + 1))
            start = at + 1
    return chunks


@given(st.lists(st.sampled_from([b"a", b"b", b"", b"cc", b"d e"]), max_size=40))
@settings(max_examples=300, deadline=None)
def test_chunk_ends_equal_the_definition(lines):
    assert lc.chunk_lines(lines) == plain_chunks(lines)


def test_columns_stay(clashing, rows, empty):
    out = lc.remove_repeated_chunks(clashing)
    assert out.columns == [*clashing.columns, "_lines", "_chunks", "_gone", "_gone_lines"]
    assert out.count() == len(rows)
    assert lc.remove_repeated_chunks(empty).count() == 0


def plain_passages(rows):
    """What is left of each document if of equal pairs of neighbouring lines all but the first go."""
    order = lambda key: (key[0] is not None, key[0] or 0, _text_key(key[1]))
    seen, out = set(), {}
    for key in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=order):
        lines, gone = key[1].split("\n"), set()
        for at, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if "".join(pair).strip():
                gone |= {at, at + 1} if pair in seen else set()
                seen.add(pair)
        out[key] = "\n".join(line for at, line in enumerate(lines) if at not in gone)
    return out


def test_every_repeated_passage_goes(spark, docs, rows, clashing):
    """Whatever the chunk ends: passages of two to six lines between other lines, and an equal text twice."""
    passages = [[f"passage {k} line {i}" for i in range(2 + k % 5)] for k in range(40)]
    made = [(1000 + i, "\n".join([f"own {i} before", *passages[i % 40], f"own {i} after"])) for i in range(120)] + [(2000, "a\na\na\n\n\n\na\na"), (2001, "x\ny"), (2002, "x\ny\nz"), (2003, "y\nz")]
    for table, data in ((spark.createDataFrame(made, "doc_id long, text string").repartition(4), made), (clashing, rows)):
        want = plain_passages(data)
        got = lc.remove_repeated_passages(table).collect()
        assert Counter((r[0], want.get((r[0], r[1]))) for r in data) == Counter((r.doc_id, r.text) for r in got)
        assert all(r._gone_lines == r._lines - len(r.text.split("\n")) for r in got if r.text)
    kept = {r.doc_id: r.text for r in lc.remove_repeated_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert all(kept[1000 + i] == f"own {i} before\nown {i} after" for i in range(40, 120))


def test_colliding_digests_do_not_lose_pairs(spark, monkeypatch):
    """All bits set, as in a table of many digests: what is nominated in vain is still read as pairs."""
    monkeypatch.setattr(lc, "_bitmap", lambda digests: bytes([255]) * (lc.BITMAP_BITS // 8))
    made = [(i, "\n".join([f"b{i}", *(f"p{i % 4} {k}" for k in range(5)), f"e{i}"])) for i in range(16)]
    got = {r.doc_id: r.text for r in lc.remove_repeated_passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: text if i < 4 else f"b{i}\ne{i}" for i, text in made}
