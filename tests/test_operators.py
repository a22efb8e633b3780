import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.errors import MissingEmbeddingsError, ModelLoadError
from lodeseek.functions import query as Q
from lodeseek.functions import text as T
from lodeseek.operators import dedup, dense, evaluation, fusion, identifiers, lexical, ranking, versions
from lodeseek.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(0, ["authenticate_user", "user", "jwt"]), (1, ["parse", "user"]), (2, ["x"]), (3, [])], "chunk_id long, tokens array<string>")


def test_bm25_equals_the_formula(spark, small):
    asked = spark.createDataFrame([(1, "user", 2.0), (1, "jwt", 1.0), (1, "unknown", 5.0)], "query_id long, term string, weight double")
    got = {r.chunk_id: r.score for r in lexical.search(small, asked, 10).collect()}

    def impact(df, dl):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / 1.5))

    assert got.keys() == {0, 1}
    assert abs(got[0] - (2 * impact(2, 3) + impact(1, 3))) < 1e-8 and abs(got[1] - 2 * impact(2, 2)) < 1e-8
    stored = lexical.score(lexical.postings(small), asked).collect()
    assert {r.chunk_id: r.score for r in stored} == got


def test_a_hot_term_is_not_dealt_by_term(spark, capsys):
    """A third of all tokens are one term: its rows get their frequency where they are."""
    rows = [(i, ["hot"] * 5 + [f"t{i % 700}", f"u{i}"] + ["x"] * (i % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "chunk_id long, tokens array<string>")
    heavy = lexical.heavy_terms(docs)
    assert {"hot", "x"} <= set(heavy)
    found = lexical.postings(docs)
    frequencies = {}
    for _, tokens in rows:
        for t in set(tokens):
            frequencies[t] = frequencies.get(t, 0) + 1
    got = found.collect()
    assert {(r.chunk_id, r.term): (r.tf, r.dl, r.df) for r in got} == {(i, t): (tokens.count(t), len(tokens), frequencies[t]) for i, tokens in rows for t in set(tokens)}
    light = found.filter(~F.col("term").isin(heavy)).groupBy("term").count().agg(F.max("count")).first()[0]
    assert light <= 3000 * 12 / lexical.HEAVY_TERMS + 5
    assert lexical.postings(docs.limit(0)).count() == 0


def test_identifiers(spark):
    chunks = spark.createDataFrame([(0, "a", "", "", ["b", "b"], "x/Net.py"), (1, "b", "K", "", [], "y.py")], "chunk_id long, function string, class_name string, parent string, calls array<string>, file string")
    asked = spark.createDataFrame([(1, ["b"], []), (2, ["k"], ["z/net.py"])], "query_id long, entity_names array<string>, file_names array<string>")
    got = {(r.query_id, r.chunk_id): r.score for r in identifiers.search(identifiers.build(chunks), asked).collect()}
    assert got == {(1, 0): 0.5, (1, 1): 1.0, (2, 1): 1.0, (2, 0): 0.8}


def unit_vectors(n, dim, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_dense_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 7)
    v = unit_vectors(200, 16)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>").repartition(5)
    asked = table.filter("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "vector")
    found = dense.search(table, asked, 5).collect()
    sql = dense.search_sql(table, asked, 5).collect()
    key = lambda rows: {(r.query_id, r.chunk_id, r["rank"]) for r in rows}
    assert key(found) == key(sql) and len(found) == 100
    assert all(r.query_id == r.chunk_id for r in found if r["rank"] == 1)
    assert dense.search(table, asked.limit(0), 5).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        dense.search(table, spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>"), 5).collect()


def test_dense_search_keeps_k_rows_and_orders_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 3)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "chunk_id long, vector array<float>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "query_id string, vector array<float>")
    rows = dense.search(same, asked, 4).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in rows} == {(q, i, i + 1) for q in "ab" for i in range(4)}
    kept, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(5, -np.inf)
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 9, (5, 60)) / 8, rng.permutation(60)
    for at in range(0, 60, 7):
        kept = dense._best(kept, floor, scores[:, at : at + 7], ids[at : at + 7], 6)
        assert len(kept[0]) <= 5 * 6
    for q in range(5):
        want = sorted(range(60), key=lambda i: (-scores[q, i], ids[i]))[:6]
        assert kept[1][kept[0] == q].tolist() == [ids[i] for i in want]


def test_dense_search_in_sql_is_for_few_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 3)
    v = unit_vectors(30, 4)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>")
    asked = table.select(F.col("chunk_id").alias("query_id"), "vector")
    key = lambda rows: {(r.query_id, r.chunk_id, r["rank"]) for r in rows.collect()}
    assert key(dense.search_sql(table, asked, 3)) == key(dense.search(table, asked, 3))


def test_threshold_search(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_ROWS", 7)
    monkeypatch.setattr(dense, "SLICE", 16)
    v = unit_vectors(120, 4, 5)
    rows = [(i, x.tolist(), None if i % 11 == 0 else i % 3) for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>, label int").repartition(4)
    asked = table.filter("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.chunk_id) for r in dense.threshold_search(table, asked, 0.5, "label").collect()}
    assert got == {(a, b) for a in range(20) for b in range(120) if rows[a][2] is not None and rows[a][2] == rows[b][2] and v[a] @ v[b] >= 0.5}
    assert dense.threshold_search(table, asked.limit(0), 0.5, "label").count() == 0


def test_containment_finds_short_and_long_items(spark):
    texts = ["one two three four five six", "xone two three four fivex", "a b", "", None, "two  three\nfour one two three four five", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = ["one two three four five", "two three", "b", "", None, "two  three", "a b c d e f", "one two three four five"]
    items = spark.createDataFrame(list(enumerate(asked)), "query_id long, item string")
    got = sorted((r.query_id, r.doc_id) for r in evaluation.containment(docs, items).collect())
    assert got == sorted((q, d) for q, item in enumerate(asked) for d, text in enumerate(texts) if item and text and item in text)


def test_containment_is_the_same_by_batches_and_by_joins(spark, monkeypatch):
    texts = ["a b c d e f", "x b c d y", "b c d", "za b c d ez", None, "", " a  b c d e", "a b c\nd e", "é b c d è b c d e", "a b c d e a b c d e", "b", "a b", "q b c d", "e"]
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(texts * 3)], "doc_id int, text string").repartition(3)
    asked = ["a b c d e", "a b c d f", "x b c d y", "  b c d", "é b c d è", " a  b c d e", "a b c d e", "b c\nd e f g", "a   e", "% b c d _"]
    items = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "query_id string, item string")
    key = lambda df: sorted((r.query_id, -1 if r.doc_id is None else r.doc_id) for r in df.collect())
    right = sorted({(f"q{q}", d if d % 5 else -1) for q, item in enumerate(asked) for d, text in enumerate(texts * 3) if text and item in text})
    monkeypatch.setattr(evaluation, "TEXTS_AT_ONCE", 4)
    assert key(evaluation.containment(docs, items)) == right
    assert evaluation.containment(docs, items.limit(0)).count() == evaluation.containment(docs.limit(0), items).count() == 0
    monkeypatch.setattr(evaluation, "is_small", lambda df: False)
    assert key(evaluation.containment(docs, items)) == [pair for pair in right if pair[1] != -1]


def test_halves(spark):
    for n in (0, 1, 2, 7, 40):
        keys = [(i, (i * 37 % 11) << 27) for i in range(n)]
        got = {r.i: r.half for r in evaluation.halves(spark.createDataFrame(keys, "i long, h long"), "h", 32, "i").collect()}
        order = sorted(range(n), key=lambda i: (keys[i][1], i))
        assert got == {i: 1 if at < (n + 1) // 2 else 2 for at, i in enumerate(order)}


def test_lsh_recall(spark):
    v = unit_vectors(400, 16, 3)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>")
    asked = table.filter("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.chunk_id) for r in dense.search(table, asked, 5).collect()}
    near = {(r.query_id, r.chunk_id) for r in dense.lsh_search(table, asked, 5, 16).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_lsh_recall_of_the_registered_query(spark):
    """On the table that it runs over, the asking vector itself left out."""
    near = {(r.query_id, r.chunk_id) for r in CATALOG["lsh_topk"](spark, "/root/testdata/sf0.1").collect() if r.query_id != r.chunk_id}
    exact = {(r.query_id, r.chunk_id) for r in CATALOG["cosine_topk"](spark, "/root/testdata/sf0.1").collect() if r.query_id != r.chunk_id}
    assert len(exact & near) / len(exact) >= 0.9


def test_lsa(spark):
    texts = ["parse the json file", "read json from a file", "open database connection", "connect to the sql database", "sort numbers in a list"] * 6
    table = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumn("tokens", T.tokens(F.col("text")))
    encoder = dense.LsaEncoder(8).fit(table)
    rows = {r.chunk_id: np.array(r.vector) for r in encoder.encode(table).collect()}
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in rows.values())
    assert rows[0] @ rows[1] > rows[0] @ rows[2] and rows[2] @ rows[3] > rows[2] @ rows[4]
    again = dense.LsaEncoder(8).fit(table)
    assert again.model_version == encoder.model_version and encoder.model_version.startswith(f"lsa-{encoder.dim}-")
    with pytest.raises(MissingEmbeddingsError):
        dense.LsaEncoder().encode(table)
    with pytest.raises(ModelLoadError):
        dense.load_encoder({"backend": "other", "fallback_to_lsa": False})
    assert dense.load_encoder({"backend": "other", "fallback_to_lsa": True}).kind == "lsa"


def test_lsa_counts_all_documents(spark):
    """Terms and their weights come from documents outside the sample for the SVD too."""
    docs = [["common", f"t{i % 5}", f"t{i % 5}"] for i in range(60)] + [[], None, ["common", None]]
    table = spark.createDataFrame(list(enumerate(docs)), "chunk_id long, tokens array<string>").repartition(3)
    encoder = dense.LsaEncoder(4, 6, 2).fit(table)
    assert list(encoder.terms) == ["common", "t0", "t1", "t2", "t3", "t4"]
    assert np.allclose(encoder.idf, [math.log(64 / 62) + 1] + [math.log(64 / 13) + 1] * 5)
    assert list(dense.LsaEncoder(4, 3, 2).fit(table).terms) == ["common", "t0", "t1"]


def test_minmax_and_fusion(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, 2.0), (2, 1, 0.0), (2, 2, 0.0), (3, 1, 4.0)], "query_id long, chunk_id long, score double")
    got = {(r.query_id, r.chunk_id): r.normal for r in fusion.minmax(rows).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 1.0}
    one = rows.filter("query_id = 1")
    gathered = fusion.gather({"bm25": one, "dense": one.filter("chunk_id < 3")})
    weights = spark.createDataFrame([(1,)], "query_id long").withColumn("weights", Q.channel_weights(F.lit("GENERAL_SEMANTIC_SEARCH"), on=(True, True, False)))
    for mode in ("weighted", "rrf"):
        found = fusion.fuse(gathered, weights, 10, mode).withColumn("method", fusion.method()).orderBy("rank").collect()
        assert found[0].chunk_id == 2 and found[0].method == "bm25+dense" and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    with pytest.raises(ValueError):
        fusion.fuse(gathered, weights, 10, "other")


def test_rerank_moves_the_head_only(spark):
    rows = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1, float(i)) for i in range(6)], "query_id long, chunk_id long, score double, rank int, metadata double")
    rows = rows.select("*", *(F.lit(0.0).alias(f) for f in ranking.FEATURES if f != "metadata"))
    out = ranking.rerank(rows, ranking.linear_score({"metadata": 1.0}), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == [2, 1, 0, 3, 4, 5]
    assert all(a.score > b.score for a, b in zip(out, out[1:], strict=False))
    with pytest.raises(ValueError, match="not_a_feature"):
        ranking.linear_score({"not_a_feature": 1.0})


def test_tree_reranker(spark):
    rng = np.random.default_rng(0)
    rows = [(q, i, float(x[0]), i + 1, *map(float, x), int(x[0] > 0.7)) for q in range(3) for i, x in enumerate(rng.random((20, len(ranking.FEATURES))))]
    table = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank int, " + ", ".join(f"{f} double" for f in ranking.FEATURES) + ", label int")
    out = ranking.TreeReranker().train(table, trees=5, depth=2).rerank(table, 20)
    best = out.groupBy("label").agg(F.avg("score").alias("s")).collect()
    assert {r.label: r.s for r in best}[1] > {r.label: r.s for r in best}[0]
    with pytest.raises(RuntimeError):
        ranking.TreeReranker().rerank(table, 5)


def results(spark, *rows):
    table = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "query_id long, chunk_id long, function string, version string, score double, file string, code string")
    return table.select("*", F.concat_ws("::", F.lit("r"), "file", F.lit("fn"), "function").alias("identity"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))


def test_versions_collapse(spark):
    body = "def {}(x):\n    return x.strip().lower()"
    one = lambda f, v, s, file="a.py", code=body: (f, v, s, file, code.format(f))
    run = lambda *rows: dedup.collapse_versions(results(spark, *rows)).orderBy(F.desc("score")).collect()
    same = run(one("f", "v1", 0.9), one("f", "v2", 0.8), one("f", "v3", 0.7, code="def f(x):\n    return 1"))
    assert len(same) == 1 and len(same[0].also_in) == 2
    renamed = run(one("normalize", "v1", 0.9), one("sanitize", "v2", 0.8))
    assert len(renamed) == 1 and renamed[0].also_in == ["v2:sanitize"]
    assert len(run(one("normalize", "v1", 0.9), one("other", "v2", 0.8, code="def other(y):\n    for i in y:\n        yield i"))) == 2
    assert len(run(one("f", "v1", 0.9), one("f", "v2", 0.8, file="b.py"))) == 2


def test_measures_by_hand(spark):
    run = spark.createDataFrame([("q1", "x", 2.0), ("q1", "a", 1.0), ("q2", "c", 3.0), ("q2", "y", 2.0), ("q2", "b", 1.0)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q1", "a", 1), ("q2", "c", 1), ("q2", "b", 1), ("q3", "z", 1), ("q4", "z", 0)], "query_id string, doc_id string, rel int")
    got = {r.query_id: r for r in evaluation.per_query(run, qrels, 10).collect()}
    assert abs(got["q1"].ndcg - 1 / math.log2(3)) < 1e-9 and abs(got["q2"].ndcg - 1.5 / (1 + 1 / math.log2(3))) < 1e-9
    assert (got["q1"].mrr, got["q2"].mrr, got["q3"].mrr, got["q4"].recall) == (0.5, 1.0, 0.0, 0.0)
    means = evaluation.evaluate(run, qrels).first()
    assert abs(means.mrr_at_10 - 1.5 / 4) < 1e-9 and means.n_queries == 4


def test_best_trial_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "trial int, score double")
    assert evaluation.best_trial(rows).first().trial == 1


def test_cache_of_another_shape_is_a_miss(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "key string, vector array<double>")
    hits, misses = versions.cache_hits(asked, cache, ["key"], "vector", F.size("vector") == 2)
    assert [r.key for r in hits.collect()] == ["a"] and [r.key for r in misses.collect()] == ["b"]
