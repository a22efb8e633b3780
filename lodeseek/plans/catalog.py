"""Queries over the driver's tables: documents are the corpus, benchmark items the queries.

A document stands for a code unit: its source is the repository, its language a folder of the file's path.
The second version of the corpus has every document with an id that leaves 0 to 2 by ten edited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import query as Q
from lodeseek.functions import text as T
from lodeseek.operators import dedup, dense, evaluation, fusion, identifiers, ivf, lambdamart, lexical, ranking, versions
from lodeseek.sources import chunker, dataset
from lodeseek.sources.scan import shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

#: Queries of all kinds, beside the benchmark's.
EXAMPLES = [
    "Where does compute_total() get its rates from in billing/invoice.py, and does TaxTable use pandas?",
    "How are incoming orders transformed before they reach the ledger?",
    "KeyError: 'port' raised while loading the profile",
    "class ReportWriter",
    "list everything in deploy.yaml",
    "render_page template",
    "what happens when the queue is full and a worker quits?",
    "how do i use the redis library to call the billing api",
    "why is the total wrong after `Basket.add_item`",
    "who uses scipy and argparse",
    "settings for the mail server and its environment variable",
    "how is the merge algorithm implemented in golang",
    "load_rates function in shop.tax.rates reads  json   files",
    "validate the token of a request and log the error",
    "size of the window in C++",
]


def query(f: Query) -> Query:
    CATALOG[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id and tokens."""
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("chunk_id"), T.ascii_tokens(F.col("text")).alias("tokens"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, term, weight of the benchmark's items."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.ascii_tokens(F.col("text"))).alias("term"))
    return items.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))


def _chunks(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """With only (a column chunk_id) those alone, so that no other text is looked at."""
    docs = _read(spark, sf_dir, "documents")
    if only is not None:
        docs = docs.join(lexical.small_or_shuffled(only.select(F.col("chunk_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    first = F.slice(F.array_distinct(T.ascii_tokens(F.col("text"))), 1, 3)
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("repository"),
        F.concat_ws("/", F.lit("src"), "source", "lang", F.concat(F.lit("FileNo"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("file"),
        F.col("lang").alias("language"),
        F.coalesce("text", F.lit("")).alias("code"),
        F.lit(1).alias("start_line"),
        F.concat(F.lit("HTTPServer"), F.upper("lang")).alias("class_name"),
        F.concat(F.lit("read_doc"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("function"),
        F.lit("method").alias("kind"),
        F.lit("").alias("parent"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("part"),
        F.lit("def read_doc(self)").alias("signature"),
        F.lit("Reads a document.").alias("doc"),
        F.array(F.lit("os.path"), F.col("lang")).alias("imports"),
        first.alias("calls"),
        F.lit("v1").alias("version"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every fiftieth vector asks, against all."""
    return _vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items.unionByName(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(EXAMPLES)], "query_id long, text string"))


def _understood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.understand(_texts(spark, sf_dir))


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def _files(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """path, blob: a second version has edits, and lacks and adds some files."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path")
    if version == 1:
        return docs.filter("doc_id % 17 <> 0").select(path, F.sha1(F.col("text").cast("binary")).alias("blob"), "doc_id")
    edited = F.when(F.col("doc_id") % 10 < 3, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 19 <> 0").select(path, F.sha1(edited.cast("binary")).alias("blob"), "doc_id")


# Text and hashes.


@query
def content_hash(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query
def exact_duplicates(spark, sf_dir):
    return dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


@query
def unit_keys(spark, sf_dir):
    """Qualified name, identity and cache key."""
    rows = _chunks(spark, sf_dir).withColumn("chash", T.content_hash(F.col("code")))
    return rows.select("chunk_id", T.qualname().alias("qualname"), T.identity().alias("identity"), T.cache_key().alias("cache_key"))


@query
def tokenize_ascii(spark, sf_dir):
    rows = _corpus(spark, sf_dir)
    return rows.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query
def tokenize_stems(spark, sf_dir):
    found = T.tokens(F.col("text"))
    return spread(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("digest"))


@query
def whitespace_collapse(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query
def line_windows(spark, sf_dir):
    rows = chunker.line_windows(_read(spark, sf_dir, "documents").filter("text is not null"), 5)
    return rows.select("doc_id", "part", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.md5(F.col("code").cast("binary")).alias("digest"))


@query
def file_stem(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"), T.short_path(F.col("url")).alias("short"))


@query
def raw_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", F.md5(T.raw_text().cast("binary")).alias("digest"))


@query
def metadata_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", T.metadata_text().alias("text"))


@query
def contextual_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", T.contextual_text().alias("text"))


@query
def lexical_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", F.md5(T.lexical_text().cast("binary")).alias("digest"))


@query
def first_sentence(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.first_sentence(F.col("text")).alias("sentence"))


@query
def highlighted(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", F.md5(T.highlighted(F.col("text"), F.array(F.lit("that"), F.lit("the"), F.lit("tion"))).cast("binary")).alias("digest"))


@query
def refactored_units(spark, sf_dir):
    """Two functions of one name in each unit, of which the first is renamed."""
    name = F.col("function")
    code = F.concat(F.lit("def "), name, F.lit("(x):\n  "), F.col("language"), F.lit("\ndef "), name, F.lit("(y): pass"))
    made = _chunks(spark, sf_dir).withColumn("code", code).withColumn("signature", F.concat(F.lit("def "), name, F.lit("("), name, F.lit(")")))
    return versions.refactored(made, F.col("chunk_id") % 10 < 3).select("chunk_id", "function", "code", "signature", "chash")


# Words.


@query
def term_freq(spark, sf_dir):
    return lexical.term_frequencies(_corpus(spark, sf_dir)).select("chunk_id", "term", "tf")


@query
def doc_freq(spark, sf_dir):
    return lexical.document_frequencies(lexical.term_frequencies(_corpus(spark, sf_dir)))


@query
def doc_stats(spark, sf_dir):
    return lexical.corpus_statistics(_corpus(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_postings(spark, sf_dir):
    rows = lexical.postings(_corpus(spark, sf_dir))
    return rows.select("chunk_id", "term", "tf", F.col("dl").cast("long").alias("dl"), "df", F.round("impact", 6).alias("impact"))


@query
def bm25_topk(spark, sf_dir):
    found = lexical.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def bm25_stored_topk(spark, sf_dir):
    """The same from stored postings and a lexicon: only folders of the queries' terms are read."""
    docs, folder = _corpus(spark, sf_dir), shared_folder(spark, "postings")
    sizes = _read(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    buckets = min(lexical.MOST_BUCKETS, sizes.bytes // 6 // lexical.TOKENS_PER_BUCKET + 3)  # a token has about 6 bytes
    stored = lexical.bucketed(lexical.counted_in_rows(docs), buckets).withColumn("version", F.lit("v1"))
    stored.write.partitionBy("version", "bucket").parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    stored.groupBy("version", "bucket", "term").agg(F.count("*").alias("df")).write.partitionBy("version", "bucket").parquet(f"{folder}/lexicon")
    tokens = stored.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    about = lexical.Statistics("v1", sizes.n, tokens / max(1, sizes.n), buckets)
    found = lexical.best_stored(stored, spark.read.parquet(f"{folder}/lexicon"), about, _asked(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def query_term_weights(spark, sf_dir):
    return Q.term_weights(_understood(spark, sf_dir))


@query
def identifier_index(spark, sf_dir):
    return identifiers.build(_chunks(spark, sf_dir))


@query
def identifier_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(1, ["read_doc7", "the"], ["fileno3.py"]), (2, ["httpserveren"], []), (3, ["nothing"], ["a/FileNo5.py"])], "query_id long, entity_names array<string>, file_names array<string>")
    return identifiers.search(identifiers.build(_chunks(spark, sf_dir)), asked)


# Understanding queries.


@query
def query_identifiers(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", _joined("identifiers"), _joined("function_names"), _joined("class_names"))


@query
def query_files(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", "text", _joined("file_names"))


@query
def query_tokens(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", _joined("tokens"))


@query
def query_categories(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", "category")


@query
def category_weights(spark, sf_dir):
    rows = _understood(spark, sf_dir).select("query_id", Q.channel_weights(F.col("category")).alias("w"))
    return rows.select("query_id", *(F.round(f"w.{c}", 6).alias(f"{c}_weight") for c in fusion.CHANNELS))


@query
def query_libraries(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", _joined("libraries"), _joined("keywords"), "language")


@query
def concept_expansion(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", _joined("expansion"), "dense_text")


@query
def last_turn_query(spark, sf_dir):
    return dataset.last_turns(_read(spark, sf_dir, "conversations"))


@query
def error_text_flag(spark, sf_dir):
    return _understood(spark, sf_dir).select("query_id", "has_error_text")


# Vectors.


@query
def cosine_topk(spark, sf_dir):
    found = dense.search(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def cosine_topk_sql(spark, sf_dir):
    """For few queries, as a join with them."""
    found = dense.search_sql(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def cosine_threshold_search(spark, sf_dir):
    """Vectors of the asking one's label with an inner product of 0.4 or more, itself left out."""
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector", "label")
    return dense.threshold_search(vectors, asked, 0.4, "label").filter("query_id <> chunk_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def lsh_topk(spark, sf_dir):
    return dense.lsh_search(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir), 10, 64).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def ivf_topk(spark, sf_dir):
    """From a stored inverted file, which is made first; how many cells are probed is measured there."""
    index = ivf.build(_vectors(spark, sf_dir), shared_folder(spark, "cells"))
    return ivf.search(index, spark, _query_vectors(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query
def lsa_encode(spark, sf_dir):
    docs = _corpus(spark, sf_dir)
    encoder = dense.LsaEncoder().fit(docs)
    return encoder.encode(docs).select("chunk_id", F.transform("vector", lambda x: F.round(x.cast("double"), 4)).alias("vector"))


# Channels to results.


def _channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """BM25; in the dense channel's place the share of a query's terms that a document has; and names, of
    which a document calls its first three tokens."""
    asked = _asked(spark, sf_dir)
    found = lexical.search_both(_corpus(spark, sf_dir), asked, 30).persist()  # 30 rows a query and measure
    names = asked.groupBy("query_id").agg(F.collect_list("term").alias("entity_names")).withColumn("file_names", F.array().cast("array<string>"))
    measured = lambda name: found.filter(F.col("measure") == name).drop("measure")
    return {"dense": measured("share"), "bm25": measured("bm25"), "identifier": identifiers.best(_chunks(spark, sf_dir), names, 30)}


def _fused(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    weights = _asked(spark, sf_dir).select("query_id").distinct().withColumn("weights", Q.channel_weights(F.lit("GENERAL_SEMANTIC_SEARCH")))
    gathered = fusion.gather(_channels(spark, sf_dir))
    rounded = gathered.withColumns({f"{c}_n": F.round(f"{c}_n", 9) for c in fusion.CHANNELS})
    return fusion.fuse(rounded, weights, 10, mode)


@query
def minmax_scores(spark, sf_dir):
    bm25 = lexical.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), 10)
    return fusion.minmax(bm25).select("query_id", "chunk_id", F.round("normal", 6).alias("normal"))


@query
def candidates_full(spark, sf_dir):
    found = fusion.gather(_channels(spark, sf_dir))
    return found.select("query_id", "chunk_id", *(F.round(f"{c}_n", 6).alias(f"{c}_n") for c in fusion.CHANNELS), fusion.method().alias("method"))


@query
def weighted_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, "weighted").select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir, "rrf").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query
def rerank_features(spark, sf_dir):
    """Features of the fused candidates, and the linear reranker's order."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fused = _fused(spark, sf_dir, "weighted").persist()  # ten rows an item
    featured = ranking.features(fused, _chunks(spark, sf_dir, fused), Q.understand(items))
    ranked = ranking.rerank(featured, ranking.linear_score({"semantic": 0.5, "bm25": 0.2, "identifier": 0.1, "metadata": 0.1, "structural": 0.1}), 5)
    return ranked.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), *(F.round(f, 6).alias(f) for f in ranking.FEATURES), ranking.explanation().alias("why"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the fused candidates, and as label whether the document holds the item's text, which is in no feature."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    fused = _fused(spark, sf_dir, "weighted").persist()  # ten rows an item
    featured = ranking.features(fused, _chunks(spark, sf_dir, fused), Q.understand(items))
    held = contained_benchmark(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"), F.lit(1.0).alias("label"))
    return featured.join(held, ["query_id", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))


@query
def gbt_rerank(spark, sf_dir):
    graded = _graded(spark, sf_dir).persist()  # ten candidates an item, read again for each step of the fit
    return ranking.TreeReranker().train(graded, trees=3, depth=2).rerank(graded, 10).select("query_id", "chunk_id", "rank")


@query
def lambdamart_rerank(spark, sf_dir):
    graded = _graded(spark, sf_dir).persist()
    return lambdamart.ListwiseReranker().train(graded, trees=3, depth=2).rerank(graded, 10).select("query_id", "chunk_id", "rank")


@query
def listwise_lambdas(spark, sf_dir):
    """By how much the listwise loss would move each candidate of BM25 that stands too low or too high."""
    run = lexical.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), 30).select("query_id", "chunk_id", F.round("score", 6).alias("score"))
    held = contained_benchmark(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"), F.lit(1.0).alias("label"))
    rows = run.join(held, ["query_id", "chunk_id"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    found = lambdamart.lambdas(lambdamart.with_ideal(rows, "label", 10))
    return found.select("query_id", "chunk_id", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("gradient", "curvature")))  # without negative zeros


@query
def structural_neighbours(spark, sf_dir):
    """Units that call a name which another unit of the same repository is filed under."""
    chunks = _chunks(spark, sf_dir)
    calls = chunks.select("chunk_id", "repository", F.explode("calls").alias("name"))
    defined = chunks.select(F.col("language").alias("name"), "repository", F.col("chunk_id").alias("target"))
    return calls.join(defined, ["repository", "name"]).groupBy("chunk_id", "name").agg(F.count("*").alias("targets"))


# Versions.


@query
def version_diff(spark, sf_dir):
    return versions.diff(_files(spark, sf_dir, 1), _files(spark, sf_dir, 2))


@query
def reused_chunks(spark, sf_dir):
    now, base = _files(spark, sf_dir, 2), _files(spark, sf_dir, 1)
    old = base.select(F.col("path").alias("file"), F.lit("c1").alias("commit"), F.lit("v1").alias("version"), F.lit(1.0).alias("timestamp"))
    return versions.reused_chunks(old, now, versions.diff(base, now), "c2", "v2", 2.0)


@query
def cache_misses(spark, sf_dir):
    _, misses = versions.cache_hits(_files(spark, sf_dir, 2), _files(spark, sf_dir, 1).withColumn("n", F.lit(1)), ["blob"], "n")
    return misses.select("path", "blob")


@query
def incremental_union(spark, sf_dir):
    """What an incremental build has: reused and parsed files; equal to a full build."""
    now, base = _files(spark, sf_dir, 2), _files(spark, sf_dir, 1)
    changes = versions.diff(base, now)
    old = base.select(F.col("path").alias("file"), "blob", F.lit("c1").alias("commit"), F.lit("v1").alias("version"), F.lit(1.0).alias("timestamp"))
    parsed = now.join(changes.select("path"), "path", "left_semi").select(F.col("path").alias("file"), "blob")
    return versions.reused_chunks(old, now, changes, "c2", "v2", 2.0).select("file", "blob").unionByName(parsed)


@query
def latest_version(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("repository"), F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderstatus").alias("commit"), F.round("o_totalprice", -4).alias("timestamp"), F.col("o_orderkey").alias("seq"))
    return versions.latest(rows)


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 results of two versions; the second scores half as high."""
    found = lexical.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), 10).persist()  # ten rows an item
    chunks = _chunks(spark, sf_dir, found).select("chunk_id", "function", F.concat_ws("::", "repository", "function").alias("identity"))
    both = found.withColumn("version", F.explode(F.array(F.lit("v1"), F.lit("v2"))))
    both = both.withColumn("timestamp", F.when(F.col("version") == "v1", 1.0).otherwise(2.0)).withColumn("score", F.when(F.col("version") == "v1", F.col("score")).otherwise(F.col("score") / 2))
    return both.join(chunks, "chunk_id").withColumn("chunk_id", F.col("chunk_id") * 2 + F.when(F.col("version") == "v1", 0).otherwise(1))


@query
def cross_version_merge(spark, sf_dir):
    return versions.merge_ranked(_versioned(spark, sf_dir), 12).select("query_id", "chunk_id", "version", F.col("rank").cast("long").alias("rank"))


@query
def dedup_identity(spark, sf_dir):
    return dedup.collapse_identities(_versioned(spark, sf_dir)).select("query_id", "identity", "chunk_id", _joined("also_in"))


@query
def dedup_rename(spark, sf_dir):
    """In the second version units with an id that leaves 0 to 2 by ten are renamed: those with 0 alone are found again,
    as 1 also got another vector and 2 another body.  A unit's vector is one of the table's."""
    rows = _versioned(spark, sf_dir).withColumn("unit", F.expr("chunk_id div 2"))
    chunks = _chunks(spark, sf_dir, rows.select(F.col("unit").alias("chunk_id"))).select(F.col("chunk_id").alias("unit"), "code", "file")
    rows = rows.join(chunks, "unit")
    edited = lambda least: (F.col("version") == "v2") & (F.pmod("unit", F.lit(10)).isin(least))
    renamed = {c: F.when(edited([0, 1, 2]), F.concat(F.lit("new_"), c)).otherwise(F.col(c)) for c in ("function", "identity")}
    place = F.pmod(F.col("unit") + F.when(edited([1]), 1).otherwise(0), F.lit(500))
    rows = rows.withColumns({**renamed, "code": F.when(edited([2]), F.lit("nothing of it is left")).otherwise(F.col("code")), "vec_id": place})
    rows = rows.join(_read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    return dedup.collapse_versions(rows).select("query_id", "chunk_id", _joined("also_in"))


@query
def duplicate_rate(spark, sf_dir):
    merged = versions.merge_ranked(_versioned(spark, sf_dir), 12)
    return evaluation.duplicate_rate(merged).select("query_id", F.round("duplicate_rate", 6).alias("duplicate_rate"))


# Evaluation.


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run of BM25, and judgements: documents that hold an item's text are relevant; every item is judged."""
    run = lexical.search(_corpus(spark, sf_dir), _asked(spark, sf_dir), 100).select("query_id", F.col("chunk_id").alias("doc_id"), "score")
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("rel"))
    return run, contained_benchmark(spark, sf_dir).unionByName(items)


@query
def evaluation_per_query(spark, sf_dir):
    rows = evaluation.per_query(*_judged(spark, sf_dir), 10)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")))


@query
def evaluation_means(spark, sf_dir):
    rows = evaluation.evaluate(*_judged(spark, sf_dir))
    return rows.select("n_queries", *(F.round(c, 6).alias(c) for c in ("ndcg_at_10", "mrr_at_10", "recall_at_10", "recall_at_100")))


@query
def contained_benchmark(spark, sf_dir):
    """Judgements by containment: items whose text a document holds."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return evaluation.containment(spread(_read(spark, sf_dir, "documents").select("doc_id", "text")), items).withColumn("rel", F.lit(1))


@query
def latency_percentiles(spark, sf_dir):
    rows = evaluation.percentiles(_read(spark, sf_dir, "events").filter("value is not null"), "value", ["event_type"])
    return rows.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")))


@query
def val_test_split(spark, sf_dir):
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.conv(F.substring(F.md5(F.col("item_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    return evaluation.halves(rows, "h", 32, "item_id").select("item_id", "half")


@query
def weight_trials(spark, sf_dir):
    """Trials of channel weights over one set of features; the best by mean reciprocal rank."""
    from lodeseek.plans.search import weight_trials as trial_scores

    features = fusion.gather(_channels(spark, sf_dir)).withColumns({c: F.round(f"{c}_n", 9) for c in fusion.CHANNELS})
    trials = spark.createDataFrame([(i, i / 10, 1 - i / 10, 0.05 * i) for i in range(11)], "trial int, dense double, bm25 double, identifier double")
    scored = trial_scores(features, trials, list(fusion.CHANNELS)).withColumn("score", F.round("score", 9))
    order = Window.partitionBy("trial", "query_id").orderBy(F.desc("score"), "chunk_id")
    relevant = contained_benchmark(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"))
    first = scored.withColumn("place", F.row_number().over(order)).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("trial", "query_id").agg(F.min("place").alias("place"))
    return first.groupBy("trial").agg(F.round(F.sum(1.0 / F.col("place")), 6).alias("reciprocal_ranks"))


# Source code.


def _source(spark: SparkSession, sf_dir: str, suffix: str, shapes: list, lines: str, first: str, last: str) -> DataFrame:
    """Pages as source files of four shapes by page_id.  The second and third have as many lines as the id tells: $N stands
    for the id, $U for the page's url."""
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[^a-z0-9:/.]", "").alias("u"))
    numbered = F.array_join(F.transform(F.sequence(F.lit(0), F.pmod("page_id", F.lit(97)) + 39), lambda i: F.concat(F.lit(lines), i.cast("string"), F.lit(first))), "\n")
    texts = [numbered if s is None else F.lit(s) for s in shapes]
    long = F.concat(F.lit(last.split("|")[0]), numbered, F.lit(last.split("|")[1]))
    broken = F.concat(F.lit(shapes[2]), numbered, F.lit("\n"))
    kind = F.pmod("page_id", F.lit(4))
    code = F.when(kind == 0, texts[0]).when(kind == 1, long).when(kind == 2, broken).otherwise(texts[3])
    code = F.replace(F.replace(code, F.lit("$N"), F.col("page_id").cast("string")), F.lit("$U"), F.col("u"))
    return chunker.chunk_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(suffix)).alias("file"), code.alias("content")), "pages")


#: The shapes of the made files: nested functions and classes, a long function, a broken file, statements alone.
PYTHON_UNITS = "import os\nfrom net import fetch\n\n@cached\ndef page_$N(x):\n    '''Doc.'''\n    def inner(y):\n        return strip(y)\n    return inner(fetch(x))\n\nclass Page(Base):\n    '''A page.'''\n    limit = 3\n\n    def url(self):\n        return join('$U')\n"
PYTHON_STATEMENTS = "import os\n\nTOTAL = compute($N)\nprint(TOTAL)\n"
BRACE_UNITS = "// Loads.\nfunction load$N(a, b) {\n  if (a) { go(b); }\n  return run(a);\n}\nclass K {\n  stop(x) {\n    const text = \"not a { brace\"; // nor { this\n    return halt(x);\n  }\n}\nconst pick$N = (a) => {\n  return find(\"$U\");\n};\n"
BRACE_STATEMENTS = "let total = $N;\nshow(total);\n"


@query
def python_chunks(spark, sf_dir):
    """Units of Python files: decorated and nested functions, classes, long functions cut between statements, windows of
    files that don't parse, and statements alone."""
    found = _source(spark, sf_dir, ".py", [PYTHON_UNITS, None, "def broken_$N(:\n", PYTHON_STATEMENTS], "    x = step(x, ", ")", "def page_$N(x):\n|\n    return x\n")
    return found.select("file", "kind", "class_name", "function", "parent", "part", "start_line", "end_line", "signature", "doc", _joined("calls"), _joined("imports"), "chash")


@query
def brace_chunks(spark, sf_dir):
    """Units of brace-language files: functions, classes, arrow functions, braces in strings and comments and on the next line,
    long functions in windows, and files without units."""
    found = _source(spark, sf_dir, ".js", [BRACE_UNITS, None, "start($N);\n", BRACE_STATEMENTS], "  a = step(a, ", ");", "function long$N(a)\n{\n|\n  return a;\n}\n")
    return found.select("file", "kind", "class_name", "function", "parent", "part", "start_line", "end_line", "signature", "doc", _joined("calls"), "chash")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten documents of every benchmark item."""
    return bm25_topk(spark, sf_dir)
