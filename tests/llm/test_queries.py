"""Each registered query over the whole tables of sf0.001 against plain Python, without the operators' own code."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor

from lodeseek.llm import quality, queries
from tests.llm.test_decontaminate import plain_search
from tests.llm.test_langid import plain_counts as plain_language_counts
from tests.llm.test_langid import plain_scorer
from tests.llm.test_linechunks import plain_passages
from tests.llm.test_mixing import plain_mix
from tests.llm.test_pii import plain_spans
from tests.llm.test_quality import plain_counts, plain_cutoffs
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    rows = pq.read_table(f"{SF}/{name}.parquet").to_pylist()
    return [tuple(r[c] for c in columns) for r in rows]


@pytest.fixture(scope="module")
def texts():
    return dict(read("documents", "doc_id", "text"))


def run(spark, name, texts=None):
    found = queries.queries()[name](spark, SF).collect()
    if texts is not None:
        assert Counter(r.doc_id for r in found) == Counter(list(texts))
    return found


def test_every_operator_has_one_query():
    assert [name.split("_")[0] for name in queries.queries()] == [f"op{n}" for n in range(1, 11)]


def test_op1(spark):
    rows = [(i, text, None, source) for i, text, source in read("documents", "doc_id", "text", "source")]
    assert Counter((r.doc_id, r.text, r["copy"]) for r in run(spark, "op1_mix_sources")) == plain_mix(rows)


def test_op2(spark, texts):
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run(spark, "op2_token_counts", texts):
        n = len(pieces.encode(texts[r.doc_id] or ""))
        assert tuple(r) == (r.doc_id, len((texts[r.doc_id] or "").encode()), n, n > 4096)


def test_op3(spark, texts):
    items = read("benchmark", "item_id", "text")
    for r in run(spark, "op3_benchmark_decontamination", texts):
        n_words, n_hit, met = plain_search(texts[r.doc_id], items)
        digest = hashlib.sha256(",".join(met).encode()).hexdigest()
        assert tuple(r) == (r.doc_id, n_words, n_hit, len(met), digest, n_hit > 0)


def test_op4(spark, texts):
    langs = dict(read("documents", "doc_id", "lang"))
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    predict = plain_scorer(plain_language_counts((langs[i], t) for i, t in texts.items() if not held[i] and langs[i] is not None))
    found = run(spark, "op4_language_id", texts)
    for r in found:
        label, score = predict(texts[r.doc_id])
        assert (r.held_out, r.lang_pred) == (held[r.doc_id], label) and abs(r.score - score) < 1e-3 and 0 <= r.score <= 1
    told = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out and langs[r.doc_id]]
    assert sum(told) >= 0.97 * len(told) > 0


def test_op5(spark, texts):
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    for r in run(spark, "op5_personal_data", texts):
        base = sorted(plain_spans(texts[r.doc_id] or ""), key=lambda s: (s[1], order[s[0]]))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in order)
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert Counter(joined) <= Counter(spans) and r.n_spans == len(spans) == len(base) + r.n_added
        places = [(int(a), order[k]) for k, a, _ in (s.split(":") for s in spans)]
        assert places == sorted(places)


def test_op6(spark, texts):
    found = run(spark, "op6_kd_tree_sharding", texts)
    slots, size = defaultdict(list), Counter()
    for r in found:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += len(raw) + 8
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in found)
    assert max(size.values()) <= sum(size.values()) / 24 + largest  # eight documents a shard


def test_op7(spark, texts):
    langs = dict(read("documents", "doc_id", "lang"))
    found = run(spark, "op7_quality_rules", texts)
    labels = defaultdict(list)
    for i, q in read("labels", "doc_id", "quality"):
        labels[i].append(q)
    design = {r.doc_id for r in spark.range(max(texts) + 1).withColumnRenamed("id", "doc_id").filter(quality.design_part("doc_id")).collect()}
    measures = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, chars, symbols, double, repeated = plain_counts(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) for line in (text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        marked = sum(w.endswith("!") for w in words)
        share = lambda a, b: a / max(b, 1)
        measures[i] = [share(symbols, n), share(repeated, n), share(double, lines), share(capitals, chars), share(marked, n), chars / max(n, 1), -chars / max(n, 1)]
    failed = {i: plain_counts(t)[0] < 50 or 2 * plain_counts(t)[4] > plain_counts(t)[0] for i, t in texts.items()}
    rows = [(langs[i] or "", min(labels[i]) > 0, i in design, measures[i]) for i in texts if labels.get(i) and not failed[i]]
    cutoffs = plain_cutoffs(rows, quality.RISK, quality.LEVEL, quality.BALANCE)
    own = {s for s, _ in cutoffs}
    for r in found:
        assert tuple(r)[:7] == (r.doc_id, *plain_counts(texts[r.doc_id]), failed[r.doc_id])
        stratum = langs[r.doc_id] or ""
        of = stratum if stratum in own else quality.REST
        out = any(value > cutoffs.get((of, m), float("inf")) for m, value in zip(quality.MEASURES, measures[r.doc_id], strict=True))
        assert r.kept == (not failed[r.doc_id] and not out)


def test_op8(spark, texts):
    want = plain_passages(list(texts.items()))
    for r in run(spark, "op8_line_chunk_dedup", texts):
        text = texts[r.doc_id]
        left = None if text is None else want[r.doc_id, text]
        assert r.text_sha256 == (None if left is None else hashlib.sha256(left.encode()).hexdigest())
        assert r.n_lines == (0 if text is None else len(text.split("\n")))
        if left:
            assert r.n_removed_lines == r.n_lines - len(left.split("\n"))


def test_op9(spark, texts):
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    least = {}
    for i, c in zip(ids, plain_components(prints), strict=True):
        least.setdefault(c, i)
    want = {i: (f"{p:016x}", least[c]) for i, p, c in zip(ids, prints, plain_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op9_simhash_near_dedup", texts)} == want


def test_op10(spark):
    pages = {i: (url, html) for i, url, html in read("pages", "page_id", "url", "html")}
    found = run(spark, "op10_warc_fixity_audit")
    assert Counter(r.page_id for r in found) == Counter(list(pages))
    archives = defaultdict(list)
    for r in found:
        url, html = (x or "" for x in pages[r.page_id])
        raw = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(html.encode())}\r\n\r\n{html}\r\n\r\n".encode()
        rotten = hashlib.md5(str(r.page_id).encode()).hexdigest()[:2] in ("00", "40", "80", "c0") and "e" in html
        assert (r.digest, r.stop_byte - r.start_byte) == (hashlib.sha256(raw).hexdigest(), len(raw))
        assert (r.status, r.intact) == (("damaged", False) if rotten else ("intact", True))
        archives[r.archive].append((r.place, r.start_byte, r.stop_byte))
    for own in archives.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [a for _, a, _ in own] == [0, *(b for _, _, b in own[:-1])]
