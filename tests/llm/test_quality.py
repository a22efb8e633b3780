import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


@given(st.text(alphabet="ab \n\t#é |", max_size=80))
@settings(max_examples=500, deadline=None)
def test_counts_equal_brute_force(text):
    assert quality.counts_of(text.encode())[:5] == plain_counts(text)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.3), (40, 2, 0.2), (500, 3, 0.02)):
        assert abs(quality.binomial_tail(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-12
    assert quality.binomial_tail(5, 5, 0.5) == 1.0


def plain_corners(tallies, balance):
    """Steps to every point from the last corner; the steepest way on is next, and of equally steep ones the longest."""
    points, at, steps = [(c, g, b) for c, g, b in tallies], (math.inf, 0, 0), []
    while True:
        ahead = [((b - at[2]) / (g - at[1]) if g > at[1] else math.inf, b, c, g) for c, g, b in points if b > at[2]]
        if not ahead or max(ahead)[0] < balance:
            return steps
        gain, b, c, g = max(ahead)
        steps.append((gain, c))
        at = (c, g, b)


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=9), st.sampled_from([0.5, 1.0, 2.0]))
@settings(max_examples=500, deadline=None)
def test_hull_steps_equal_brute_force(increments, balance):
    good = bad = 0
    tallies = []
    for at, (g, b) in enumerate(increments):
        good, bad = good + g, bad + b
        tallies.append((float(-at), good, bad))
    assert [(round(g, 9), c) for g, c in quality.hull_steps(tallies, balance)] == [(round(g, 9), c) for g, c in plain_corners(tallies, balance)]


def test_shares_pass_on():
    n = quality.least_good(0.02, 0.025)  # enough for a half of the level, not for a third
    assert quality.proved({"a": (n, [0, 0]), "b": (n, [0])}, 0.02, 0.05) == {"a": 2, "b": 1}
    assert quality.proved({"a": (n, [0]), "b": (n, [0]), "c": (n, [0])}, 0.02, 0.05) == {"a": 0, "b": 0, "c": 0}
    large = 3 * n
    assert quality.proved({"a": (large, [0]), "b": (n, [0]), "c": (n, [0, n])}, 0.02, 0.05) == {"a": 1, "b": 1, "c": 1}
    assert quality.proved({"a": (large, [0, 0, large, 0])}, 0.02, 0.05) == {"a": 2}
    assert quality.proved({}, 0.02, 0.05) == {}


def test_the_guarantee_holds_in_simulations():
    """Policies whose true rates are known: over many holdouts, any of three strata has one proved that rejects too
    many in at most the level's share of them (and near it, where all rates are at the risk's edge)."""
    rng, risk, level, runs = np.random.default_rng(3), 0.05, 0.1, 2000
    for rates in ([0.0501, 0.08], [0.01, 0.0501], [0.0, 0.02, 0.051, 0.2]):
        wrong = 0
        for _ in range(runs):
            seen = {}
            for stratum in "abc":
                u = np.sort(rng.random(300))
                seen[stratum] = (300, [int(np.searchsorted(u, r)) for r in rates])
            wrong += any(n and rates[n - 1] > risk for n in quality.proved(seen, risk, level).values())
        assert wrong / runs < level + 3 * math.sqrt(level * (1 - level) / runs)


def graded(spark, shift):
    """Good documents have few symbols; bad ones many, as does a share of the good ones given by shift."""
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        symbols = 40 if bad or i % 1000 < shift else i % 3
        words = [f"w{(i * 7 + k * k) % 997}x{k}" for k in range(60)]
        rows.append((i, " ".join(words) + " " + "# " * symbols, "en" if i % 2 else "de"))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_bad_documents_go_and_good_ones_stay(spark):
    docs, labels = graded(spark, 0)
    got = quality.judge(docs, labels, risk=0.2).collect()
    assert not any(r.base_failed for r in got)
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)


def test_no_cutoff_without_proof(spark):
    docs, labels = graded(spark, 0)
    few = quality.choose_cutoffs(quality.measured(docs), labels.filter("doc_id < 100"))
    assert all(c == math.inf for c in few.values())
    risky, labels = graded(spark, 200)  # a cutoff that catches the bad ones would reject a fifth of the good ones
    for (_, measure), cutoff in quality.choose_cutoffs(quality.measured(risky), labels, risk=0.1).items():
        assert not (measure == "symbols_per_word" and cutoff < 0.3)


def plain_cutoffs(rows, risk, level, balance):
    """rows: stratum, good, in the design, measures.  The same choice in plain Python, quantiles of the design included."""
    test = [r for r in rows if not r[2] and r[1]]
    sizes = Counter(r[0] for r in test)
    likely = [s for s, n in sizes.items() if n >= quality.least_good(risk, level)]
    own = {s for s in likely if sizes[s] >= quality.least_good(risk, level / (len(likely) + 1))}
    named = lambda s: s if s in own else quality.REST
    paths, seen = {}, {}
    for stratum in {named(r[0]) for r in rows if r[2]}:
        design = [r for r in rows if r[2] and named(r[0]) == stratum]
        steps = []
        for at in range(len(quality.MEASURES)):
            values = sorted(r[3][at] for r in design)
            cutoffs = {values[max(0, math.ceil((1 - 0.5 ** (1 + k / 2)) * len(values)) - 1)] for k in range(quality.CANDIDATES)}
            tallies = [(c, sum(r[3][at] > c and r[1] for r in design), sum(r[3][at] > c and not r[1] for r in design)) for c in sorted(cutoffs, reverse=True)]
            steps += [(-gain, at, number, cutoff) for number, (gain, cutoff) in enumerate(plain_corners(tallies, balance))]
        paths[stratum] = [(at, cutoff) for _, at, _, cutoff in sorted(steps)]
        good = [r for r in test if named(r[0]) == stratum]
        if paths[stratum] and len(good) >= quality.least_good(risk, level):
            seen[stratum] = (len(good), [sum(any(r[3][a] > c for a, c in paths[stratum][: n + 1]) for r in good) for n in range(len(paths[stratum]))])
    out = {(s, m): math.inf for s in own for m in quality.MEASURES}
    for stratum, n in quality.proved(seen, risk, level).items():
        out |= {(stratum, quality.MEASURES[a]): c for a, c in paths[stratum][:n]}
    return out


def test_selection_equals_brute_force(spark):
    """On the tables of sf0.01, with strata large and small."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    features = quality.measured(docs)
    joined = features.filter("not base_failed").join(labels.groupBy("doc_id").agg({"quality": "min"}), "doc_id").withColumn("design", quality.design_part(features.doc_id))
    rows = [(r.stratum, r["min(quality)"] > 0, r.design, [r[m] for m in quality.MEASURES]) for r in joined.collect()]
    for risk in (0.02, 0.1):
        want = plain_cutoffs(rows, risk, quality.LEVEL, quality.BALANCE)
        assert quality.choose_cutoffs(features, labels, risk=risk) == want
        assert any(c < math.inf for c in want.values())


def test_defined_results(spark, docs, clashing, rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = quality.judge(clashing, labels).collect()
    want = Counter((r[0], *plain_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).count() == len(rows)


def test_all_strata_with_labels_enough_have_cutoffs(spark):
    """220 strata of 160 good and 40 bad documents, and many with few labels, which are judged together."""
    from pyspark.sql import functions as F

    rows = spark.range(220 * 200 + 900).withColumn("stratum", F.expr("if(id < 44000, concat('s', id % 220), concat('few', id % 300))")).withColumn("bad", F.expr("id div 220 % 5 = 0"))
    features = rows.select(F.col("id").alias("doc_id"), "stratum", F.lit(False).alias("base_failed"), *(F.when(F.col("bad") & F.lit(m == "symbols_per_word"), 1.0).otherwise(0.0).alias(m) for m in quality.MEASURES))
    labels = rows.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    found = {key: c for key, c in quality.choose_cutoffs(features, labels, risk=0.15).items() if c < math.inf}
    assert found == {(s, "symbols_per_word"): 0.0 for s in [quality.REST, *(f"s{k}" for k in range(220))]}


def test_a_stratum_without_a_proved_policy_does_not_take_that_of_the_rest(spark):
    features = spark.createDataFrame([("a", *[1.0] * 7), ("b", *[1.0] * 7)], "stratum string, " + ", ".join(f"{m} double" for m in quality.MEASURES))
    cutoffs = {("a", m): math.inf for m in quality.MEASURES} | {(quality.REST, "mark_share"): 0.5}
    assert {r.stratum: r.rejected for r in quality.with_verdict(features, cutoffs).collect()} == {"a": False, "b": True}


def test_least_good_is_where_proof_begins():
    for rate, level in ((0.05 / 7, 0.05), (0.1, 0.05), (0.3, 0.01)):
        n = quality.least_good(rate, level)
        assert quality.binomial_tail(0, n, rate) <= level < quality.binomial_tail(0, n - 1, rate)
