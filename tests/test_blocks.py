import numpy as np
from pyspark.sql import functions as F

from lodeseek.operators import blocks, dense, identifiers, lexical


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark):
    rng = np.random.default_rng(3)
    words = ["the", "of", "to", *(f"w{i}" for i in range(40))]
    rows = [(i, [words[int(x)] for x in np.minimum(rng.geometric(0.15, size=rng.integers(0, 30)) - 1, 42)]) for i in range(400)]
    rows += [(1000 + i, ["the", "of"]) for i in range(300)] + [(2000, None)]
    return spark.createDataFrame(rows, "chunk_id long, tokens array<string>").repartition(5)


def queries(spark):
    rows = [(q, t, float(1 + n % 2)) for q in range(7) for n, t in enumerate(["the", "of", f"w{q}", f"w{3 * q}x", f"w{q + 20}"])]
    return spark.createDataFrame(rows, "query_id long, term string, weight double")


def test_pairs_of_a_common_word_stay_in_their_task(spark, monkeypatch):
    """Every row has a word of every query: pairs are neither shuffled nor kept in a hash table, and results are those of the join."""
    docs, asked = corpus(spark), queries(spark)
    found = lexical.search(docs, asked, 10)
    assert "MapInArrow" in plan(found) and "hashpartitioning(chunk_id" not in plan(found) and "HashAggregate" not in plan(found)
    got = sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect()))
    both = sorted(map(tuple, lexical.search_both(docs, asked, 10).collect()))
    monkeypatch.setattr(blocks, "MOST_CELLS", 1)  # as a batch too large for a matrix
    joined = lexical.search(docs, asked, 10)
    assert "MapInArrow" not in plan(joined)
    assert got == sorted(map(tuple, joined.select("query_id", "chunk_id", "score", "rank").collect())) and len(got) == 70
    assert both == sorted(map(tuple, lexical.search_both(docs, asked, 10).collect()))
    assert lexical.search(docs.limit(0), asked, 10).count() == lexical.search(docs, asked.limit(0), 10).count() == 0


def test_names_meet_the_queries_in_their_row(spark, monkeypatch):
    rows = [(i, f"f{i % 5}", "K" if i % 3 else "", "", ["f1", "go"], f"a/Net{i % 4}.py") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, function string, class_name string, parent string, calls array<string>, file string")
    asked = spark.createDataFrame([(1, ["f1", "f1"], []), (2, ["k"], ["z/net3.py"]), (3, ["go"], ["net0.py", "net1.py"]), (4, [], [])], "query_id long, entity_names array<string>, file_names array<string>")
    found = identifiers.best(chunks, asked, 30)
    assert "MapInArrow" in plan(found) and "HashAggregate" not in plan(found)
    columns = ("query_id", "chunk_id", "score", "rank")
    monkeypatch.setattr(blocks, "MOST_CELLS", 0)
    joined = lexical.top_k(identifiers.search(identifiers.build(chunks), asked), 30)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, joined.select(*columns).collect()))


def test_a_batch_too_large_for_one_matrix_is_cut_by_queries(spark, monkeypatch):
    """Its pairs were summed in hash tables."""
    docs, asked = corpus(spark), queries(spark)
    whole = sorted(map(tuple, lexical.search_both(docs, asked, 10).collect()))
    rows = [(i, f"f{i % 5}", "K" if i % 3 else "", "", ["f1", "go"], f"a/Net{i % 4}.py") for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, function string, class_name string, parent string, calls array<string>, file string")
    named = spark.createDataFrame([(1, ["f1", "f1"], []), (2, ["k"], ["z/net3.py"]), (3, ["go"], ["net0.py", "net1.py"]), (4, [], []), (5, [], ["net2.py"])], "query_id long, entity_names array<string>, file_names array<string>")
    names = sorted(map(str, identifiers.best(chunks, named, 30).collect()))
    monkeypatch.setattr(blocks, "MOST_CELLS", 20)  # two or three queries of five words
    parts = list(blocks.batch_of(asked).parts())
    assert len(parts) == 4 and all(p.weights.size <= 20 for p in parts) and sum(p.weights.shape[1] for p in parts) == 7
    found = lexical.search_both(docs, asked, 10)
    assert "MapInArrow" in plan(found) and "HashAggregate" not in plan(found)
    assert sorted(map(tuple, found.collect())) == whole
    monkeypatch.setattr(blocks, "MOST_CELLS", 3)
    found = identifiers.best(chunks, named, 30)
    assert "MapInArrow" in plan(found) and "HashAggregate" not in plan(found)
    assert sorted(map(str, found.collect())) == names and len(names) > 100


def test_of_many_equal_scores_the_smallest_ids_stay():
    kept, floor = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(3, -np.inf)
    rng = np.random.default_rng(0)
    ids, scores = rng.permutation(500), rng.integers(0, 3, size=(3, 500)).astype(float)
    for at in range(0, 500, 100):
        kept = dense._best(kept, floor, scores[:, at : at + 100], ids[at : at + 100], 4)
    expected = [(q, i) for q in range(3) for _, i in sorted((-scores[q, c], ids[c]) for c in range(500))[:4]]
    assert list(zip(kept[0], kept[1], strict=True)) == expected


def vectors(spark, n=2500, dim=16):
    made = np.random.default_rng(5).normal(size=(n, dim))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    made[1::50] = made[::50]  # copies of what asks
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "chunk_id long, vector array<double>").repartition(4)
    return made, table, table.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def test_many_queries_are_not_joined_with_all_vectors(spark):
    """Their pairs would be sorted."""
    _, table, asked = vectors(spark)
    found = dense.search_sql(table, asked, 5)  # 125 queries
    assert "MapInArrow" in plan(found) and "Join" not in plan(found)
    few = asked.filter("query_id < 500")
    joined = dense.search_sql(table, few, 5)
    assert "NestedLoopJoin" in plan(joined) or "Cartesian" in plan(joined)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())
    assert key(joined) == [x for x in key(found) if x[0] < 500]


def test_lsh_pairs_stay_in_their_task(spark):
    """All vectors in a probed bucket are compared, no other; pairs are not shuffled."""
    made, table, asked = vectors(spark)
    found = dense.lsh_search(table, asked, 5, 16, tables=3, bits=6)
    assert "Join" not in plan(found) and "HashAggregate" not in plan(found)
    planes = np.random.default_rng(0).normal(size=(3, 6, 16))
    signs = np.einsum("tbd,nd->ntb", planes, made) > 0
    expected = set()
    for q in range(0, 2500, 20):
        near = np.flatnonzero(((signs != signs[q]).sum(axis=2) <= 1).any(axis=1))
        expected |= {(q, int(i)) for _, i in sorted((-round(float(made[q] @ made[i]), 9), i) for i in near)[:5]}
    assert {(r.query_id, r.chunk_id) for r in found.collect()} == expected


def test_stored_postings_meet_the_queries_in_their_tasks(spark, tmp_path, monkeypatch):
    docs, asked = corpus(spark).filter("tokens is not null"), queries(spark)
    monkeypatch.setattr(lexical, "SORTED_ROWS", 100)
    postings = lexical.bucketed(lexical.counted_in_rows(docs), 5).withColumn("version", F.lit("v1"))
    postings.write.partitionBy("version", "bucket").parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    lexicon = stored.groupBy("version", "bucket", "term").agg(F.count("*").alias("df"))
    sizes = lexical.corpus_statistics(docs).first()
    about = lexical.Statistics("v1", sizes.n, sizes.avgdl, 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a chunk's rows lie in several batches
    try:
        found = lexical.best_stored(stored, lexicon, about, asked, 10)
        assert "HashAggregate" not in plan(found)
        columns = ("query_id", "chunk_id", "score", "rank")
        got = sorted(map(tuple, found.select(*columns).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, lexical.search(docs, asked, 10).select(*columns).collect()))


def test_only_rare_terms_are_dealt_by_term(spark, monkeypatch):
    """No more than the terms that may be broadcast, and of these the most frequent; texts aren't read for means."""
    docs = corpus(spark).filter("tokens is not null")
    whole = sorted(map(tuple, lexical.postings(docs).collect()))
    known = docs.select("chunk_id", F.explode("tokens").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"), F.count("*").alias("tokens"))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 5)
    level, _ = lexical._common_level(known)
    assert 0 < known.filter(F.col("df") >= 2**level).count() <= 5
    assert sorted(map(tuple, lexical.postings(docs).collect())) == whole
