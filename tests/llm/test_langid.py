import math
import zlib
from collections import Counter

import numpy as np
import regex

from lodeseek.llm import langid


def test_held_out_accuracy_and_defined_results(docs, rows):
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    got = langid.predict(docs, model, ["doc_id", "text", "lang"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r._score <= 1
        assert (r._lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    told = [r for r in got if r.lang and r.doc_id is not None and r.doc_id < 49 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(told) > 5 and np.mean([r._lang_pred == r.lang for r in told]) > 0.9


def test_held_out_rows_teach_nothing(spark, docs, rows):
    kept = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    changed = [(*r[:2], "xx", *r[3:]) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 == 2 else r for r in rows]
    a = langid.fit(spark.createDataFrame(changed, docs.schema))
    b = langid.fit(spark.createDataFrame(kept, docs.schema))
    assert a.languages == b.languages and a.words == b.words and np.array_equal(a.gains, b.gains)


def plain_scorer(counts):
    """The scheme by its definition, with dictionaries: text to label and score.  counts: language, kind, item, how often."""
    languages = sorted({c[0] for c in counts})
    table = {(kind, item, lang): n for lang, kind, item, n in counts}
    known = {(c[1], c[2]) for c in counts}
    totals = {}
    for kind in {c[1] for c in counts}:
        items = sum(k == kind for k, _ in known)
        totals |= {(kind, lang): sum(n for (k, _, la), n in table.items() if k == kind and la == lang) + langid.SMOOTHING * items for lang in languages}
    most = {kind: max(totals[kind, lang] for lang in languages) for kind, _ in totals}
    log = lambda kind, item, lang: math.log((table[kind, item, lang] + langid.SMOOTHING) / totals[kind, lang]) if (kind, item, lang) in table else math.log(langid.SMOOTHING / most[kind])

    def score(word):
        if (0, word) in known:
            return [log(0, word, lang) for lang in languages]
        for length in range(langid.LONGEST_GRAM, 0, -1):
            padded = f" {word} "
            grams = [g for i in range(len(padded) - length + 1) for g in [padded[i : i + length]] if (length, g) in known]
            if grams:
                return [sum(log(length, g, lang) for g in grams) / len(grams) for lang in languages]
        return [0.0] * len(languages)

    def predict(text):
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
        if not words:
            return "und", 0.0
        scores = [score(w) for w in words]
        means = [sum(s[i] for s in scores) / len(words) for i in range(len(languages))]
        best = max(range(len(languages)), key=lambda i: (means[i], -i))
        return languages[best], 1 / sum(math.exp((m - means[best]) * min(len(words), langid.SURE_WORDS)) for m in means)

    return predict


def plain_counts(texts):
    """texts: (label, text).  What the sample counts."""
    counts = Counter()
    for lang, text in texts:
        for word in regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower()):
            counts[lang, 0, word] += 1
            for length in range(1, langid.LONGEST_GRAM + 1):
                for i in range(len(word) + 3 - length):
                    counts[lang, length, f" {word} "[i : i + length]] += 1
    return [(*key, n) for key, n in counts.items()]


def test_equals_brute_force(docs, rows):
    """All rows that aren't held out are in the sample here."""
    taught = [(r[2], r[1]) for r in rows if r[0] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    predict = plain_scorer(plain_counts(taught))
    for r in langid.predict(docs, langid.fit(docs), ["text"]).collect():
        if len(r.text or "") < 10_000:
            label, score = predict(r.text)
            assert r._lang_pred == label and abs(r._score - score) < 1e-3


def test_every_label_is_learned(spark):
    """Three hundred languages of one word each, one row for most."""
    table = spark.createDataFrame([(i, "".join(chr(97 + int(d)) for d in str(1000 + i % 300)), f"l{i % 300:03}") for i in range(4000)], "doc_id long, text string, lang string")
    model = langid.fit(table, rows_per_language=8)
    assert len(model.languages) > 290
    wrong = [r for r in langid.predict(table, model, ["lang"]).collect() if r.lang in model.languages and r._lang_pred != r.lang]
    assert not wrong


def test_marks_do_not_cut_words():
    assert langid.words_of("हिन्दी में") == ["हिन्दी", "में"]
    assert langid.words_of("e\u0301cole x2y _a") == ["e\u0301cole", "x", "y", "a"]
    assert langid.words_of("ABC def") == ["abc", "def"]


def test_long_texts_are_scored_in_slabs(monkeypatch):
    model = langid._model([("a", 0, "x", 5), ("b", 0, "y", 5), ("b", 2, "zz", 5)])
    whole = langid.Scorer(model).predict("x y zzz " * 1000)
    monkeypatch.setattr(langid, "SLAB", 7)
    part = langid.Scorer(model).predict("x y zzz " * 1000)
    assert whole[0] == part[0] and abs(whole[1] - part[1]) < 1e-9


def test_backoff_uses_the_longest_known_gram():
    counts = [("a", 0, "abcdef", 5), ("b", 0, "zzz", 5), ("a", 3, "bcd", 4), ("b", 2, "bc", 9), ("a", 1, "q", 1), ("a", 1, "z", 40), ("b", 1, "q", 30)]
    scorer = langid.Scorer(langid._model(counts))
    assert scorer.predict("abcdef")[0] == "a"
    assert scorer.predict("xbcdx")[0] == "a"  # the trigram decides, not the bigram
    assert scorer.predict("xbcx")[0] == "b"
    assert scorer.predict("q")[0] == "b"
    assert scorer.predict("ww") == ("a", 0.5)
    assert scorer.predict("123 !") == scorer.predict("² ½") == ("und", 0.0)


def test_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(langid, "MEMORY", 10)
    scorer = langid.Scorer(langid._model([("a", 0, "x", 5), ("b", 1, "y", 5)]))
    first = scorer.predict("yy yyy")
    for i in range(50):
        scorer.predict("abc" + chr(97 + i % 26) * (i % 7))
        assert scorer.items < 30
    assert scorer.predict("yy yyy") == first and len(scorer) < 30


def test_rejection_keeps_columns_and_rows(clashing, rows):
    kept = langid.identified(clashing, langid.fit(clashing), 0.35)
    assert kept.columns == clashing.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r[1] for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_empty_table(empty):
    model = langid.fit(empty)
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    assert langid.Scorer(model).predict("word") == ("und", 0.0)
