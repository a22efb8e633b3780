import hashlib
import math
from collections import Counter, defaultdict

import pytest

from lodeseek.llm import mixing


def plain_mix(rows, weights=None):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len((r[1] or "").encode()) + 8
    weight = {s: math.sqrt(b) if weights is None else weights.get(s, 0) for s, b in size.items()}
    out = Counter()
    for r in rows:
        mean = weight[r[3]] / sum(weight.values()) * sum(size.values()) / size[r[3]]
        digest = hashlib.md5("|".join(["mix-1", "" if r[0] is None else str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()]).encode()).hexdigest()
        u, k, total = int(digest[:13], 16) / 2**52, 0, math.exp(-mean)
        while total <= u:
            k += 1
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        for copy in range(k):
            out[r[0], r[1], copy] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.text, r[-2]) for r in df.collect())


def test_equals_brute_force(docs, rows):
    assert found(mixing.mix(docs, mixing.source_rates(docs))) == plain_mix(rows)


def test_explicit_weights_and_salted_join(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    weights = {"src0": 1.0, "src3": 5.0, None: 2.0}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    assert found(mixing.mix(docs, mixing.source_rates(docs, table))) == plain_mix(rows, weights)


def test_means_come_out(spark):
    big = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'a', 'b') as source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    n = Counter(r.source for r in mixing.mix(big, mixing.source_rates(big, weights)).select("source").collect())
    assert abs(n["a"] - 10_000) < 350 and abs(n["b"] - 10_000) < 350


def test_columns_stay(clashing, rows):
    mixed = mixing.mix(clashing, mixing.source_rates(clashing))
    assert mixed.columns == [*clashing.drop("_copy", "_place").columns, "_copy", "_place"]
    assert mixed.count() == sum(plain_mix(rows).values())


def test_no_python_in_the_plan(docs, capsys):
    mixing.mix(docs, mixing.source_rates(docs)).explain()
    assert "Python" not in capsys.readouterr().out


def test_too_large_a_mean_is_an_error(spark, docs):
    table = spark.createDataFrame([("src1", 1.0)], "source string, weight double")
    with pytest.raises(Exception, match="repeated"):
        mixing.source_rates(docs, table, total_bytes=10**12)


def test_empty_table(empty):
    assert mixing.mix(empty, mixing.source_rates(empty)).count() == 0


def test_large_means_are_drawn(spark):
    """A source of one empty text beside a large one, by the built-in weights; no mean is too large."""
    made = [(i, "word " * 10_000, "en", "hot", 0) for i in range(6)] + [(10 + i, None if i else "", "en", f"tiny{i}", 0) for i in range(3)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    rates = mixing.source_rates(table, evenness=0.0)
    means = {r.source: r.rate for r in rates.collect()}
    assert means["tiny0"] > 1.5 * mixing.LARGEST_MEAN and all(r.cumulative is None for r in rates.collect() if r.rate > mixing.TABULATED_MEAN)
    got = found(mixing.mix(table, rates))
    assert got == plain_mix(made, dict.fromkeys(means, 1.0))
    for i in range(3):
        n = sum(doc == 10 + i for doc, _, _ in got)
        assert abs(n - means[f"tiny{i}"]) < 6 * math.sqrt(n)


def test_counts_are_those_of_the_table(spark):
    us = spark.range(400).selectExpr("id / 400D as u", "double(id % 90) as mean")
    from pyspark.sql import functions as F

    a = F.size(F.filter(mixing.cumulative_poisson(F.col("mean")), lambda c: c <= F.col("u")))
    assert us.filter("mean > 0").filter(a != mixing.poisson_count(F.col("mean"), F.col("u"))).count() == 0
