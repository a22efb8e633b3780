"""Measurements over a dataset: presets, representations, tuned weights, versions and throughput."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.config import load_config
from lodeseek.functions import query as Q
from lodeseek.functions import text as T
from lodeseek.operators import dense, evaluation, lambdamart, lexical, ranking, versions
from lodeseek.plans.index import index_chunks, index_dataset
from lodeseek.plans.search import PRESETS, Engine, Options
from lodeseek.sources.dataset import Dataset


def split_queries(queries: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Halves for validation and test, equal but for one query, by a hash of the id."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string")).cast("binary"))
    keyed = queries.withColumn("_key", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    halved = evaluation.halves(keyed, "_key", 32, "query_id").drop("_key")
    return halved.filter("half = 1").drop("half"), halved.filter("half = 2").drop("half")


def _measured(engine: Engine, queries: DataFrame, qrels: DataFrame, options: Options) -> dict[str, Any]:
    began = time.time()
    judged = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    measures = evaluation.evaluate(engine.run(queries, options=options), judged).first().asDict()
    return {**measures, "wall_s": round(time.time() - began, 2)}


def ablation(spark: SparkSession, dataset: Dataset, folder: str, presets: dict[str, Options] = PRESETS, representations: tuple[str, ...] = ("contextual",), learned: bool = False, seed: int = 0) -> Iterator[dict[str, Any]]:
    """A row of measures for each representation and preset.  learned: measured on the test half, with three more rows, of
    tuned weights and of pointwise and listwise trees, for which the validation half serves."""
    for mode in representations:
        config = load_config(overrides={"index.dir": f"{folder}/{mode}", "representation": mode})
        began = time.time()
        index_dataset(spark, dataset.corpus, dataset.name, config)
        built, engine = time.time() - began, Engine(spark, dataset.name, config)
        asked = split_queries(dataset.queries, seed)[1] if learned else dataset.queries
        about = {"representation": mode, "build_s": round(built, 2)}
        for name, options in presets.items():
            yield about | {"approach": name} | _measured(engine, asked, dataset.qrels, options)
        if learned:
            tuned = load_config(overrides={"index.dir": f"{folder}/{mode}", "representation": mode, **tuned_weights(engine, dataset, seed=seed)})
            yield about | {"approach": "tuned"} | _measured(Engine(spark, dataset.name, tuned), asked, dataset.qrels, Options())
            for kind, reranker in (("trees", ranking.TreeReranker()), ("listwise", lambdamart.ListwiseReranker())):
                trained = trained_reranker(engine, dataset, seed, reranker)
                yield about | {"approach": kind} | _measured(Engine(spark, dataset.name, config, trained), asked, dataset.qrels, Options())


#: Parameters of the Dirichlet draws of channel weights and of the linear reranker's weights.
CHANNEL_PRIOR = {"dense": 2.0, "bm25": 1.5, "identifier": 0.7}
FEATURE_PRIOR = {"semantic": 3.0, "bm25": 1.5, "identifier": 0.7, "metadata": 1.0, "structural": 0.7}


def tuned_weights(engine: Engine, dataset: Dataset, trials: int = 30, seed: int = 0) -> dict[str, Any]:
    """Settings, as overrides, of the trial with the best nDCG on the validation half: the weights of the channels and of the
    linear reranker.  Trial 0 has the configured ones, so many others are Dirichlet draws.  All trials are one plan over
    the candidates and features, which are computed once."""
    rng, settings = np.random.default_rng(seed), engine.config
    rows = [(0, *(float(settings["retrieval"][f"{c}_weight"]) for c in CHANNEL_PRIOR), *(float(settings["ranking"]["weights"].get(f, 0.0)) for f in FEATURE_PRIOR))]
    rows += [(i, *map(float, rng.dirichlet(list(CHANNEL_PRIOR.values()))), *map(float, rng.dirichlet(list(FEATURE_PRIOR.values())))) for i in range(1, trials + 1)]
    table = engine.spark.createDataFrame(rows, "trial int, " + ", ".join(f"c_{c} double" for c in CHANNEL_PRIOR) + ", " + ", ".join(f"{f} double" for f in FEATURE_PRIOR))
    validation, _ = split_queries(dataset.queries, seed)
    tables = engine._tables(engine.versions().collect()[-1].label)
    understood = engine.understand(validation)
    featured = engine.featured(understood, tables, Options(), ("doc_id",), whole=True).join(understood.select("query_id", "category"), "query_id")
    pairs = featured.select("query_id", "chunk_id", "doc_id", "category", *(f"{c}_n" for c in CHANNEL_PRIOR), *(F.col(f).alias(f"f_{f}") for f in FEATURE_PRIOR)).crossJoin(F.broadcast(table))  # some tens of trials
    shares = Q.channel_weights(F.col("category"), tuple(F.col(f"c_{c}") for c in CHANNEL_PRIOR), by_category=settings["retrieval"]["category_weights"])
    fused = pairs.withColumn("w", shares).withColumn("fused", sum((F.col(f"w.{c}") * F.col(f"{c}_n") for c in CHANNEL_PRIOR), F.lit(0.0)))
    keyed = fused.withColumn("query_id", F.concat_ws("|", "trial", "query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id"))
    head = keyed.withColumn("place", place).filter(F.col("place") <= settings["ranking"]["rerank_top_n"])
    linear = sum((F.col(f) * F.col(f"f_{f}") for f in FEATURE_PRIOR), F.lit(0.0))
    run = head.groupBy("query_id", "doc_id").agg(F.max(linear).alias("score"))
    judged = dataset.qrels.join(validation.select("query_id"), "query_id", "left_semi").crossJoin(F.broadcast(table.select("trial")))
    judged = judged.select(F.concat_ws("|", "trial", "query_id").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "rel")
    measured = evaluation.per_query(run, judged, 10).groupBy(F.split_part("query_id", F.lit("|"), F.lit(1)).cast("int").alias("trial")).agg(F.avg("ndcg").alias("score"))
    best = rows[evaluation.best_trial(measured).first().trial]
    n = len(CHANNEL_PRIOR)
    return {f"retrieval.{c}_weight": x for c, x in zip(CHANNEL_PRIOR, best[1 : n + 1], strict=True)} | {"ranking.weights": dict(zip(FEATURE_PRIOR, best[n + 1 :], strict=True))}


def trained_reranker(engine: Engine, dataset: Dataset, seed: int = 0, reranker: Any = None) -> Any:
    """The reranker (LambdaMART, if none is given) trained on the validation half's candidates, labelled by the judgements."""
    reranker = reranker or lambdamart.ListwiseReranker()
    validation, _ = split_queries(dataset.queries, seed)
    tables = engine._tables(engine.versions().collect()[-1].label)
    featured = engine.featured(engine.understand(validation), tables, Options())
    judged = dataset.qrels.select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rel")
    labelled = featured.join(tables["chunks"].select("chunk_id", "doc_id"), "chunk_id").join(judged, ["query_id", "doc_id"], "left").withColumn("label", F.coalesce("rel", F.lit(0)))
    return reranker.train(labelled)


def version_experiment(spark: SparkSession, units: DataFrame, queries: DataFrame, folder: str, share: float = 0.3, seed: int = 0) -> dict[str, float]:
    """units: chunks of one version with doc_id; queries: query_id, text and the doc_id asked for.  A second
    version has a share of the units renamed; both are searched together, with and without collapse."""
    config = load_config(overrides={"index.dir": folder})
    edited = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1000)) < int(share * 1000)
    fixed = units.withColumns({"repository": F.lit("units"), "version": F.lit("v1"), "commit": F.lit("v1"), "timestamp": F.lit(1.0)})
    later = versions.refactored(fixed, edited).withColumns({"version": F.lit("v2"), "commit": F.lit("v2"), "timestamp": F.lit(2.0)})
    index_chunks(spark, fixed, "units", "v1", config, 1.0)
    second = index_chunks(spark, later, "units", "v2", config, 2.0)
    engine, out = Engine(spark, "units", config), {"computed_on_v2": second["embeddings_computed"], "cached_on_v2": second["embeddings_cached"]}
    for name, history in (("all", True), ("collapsed", False)):
        found = engine.search(queries.select("query_id", "text"), "all", 30, history=history).persist()
        out[f"duplicate_rate_{name}"] = evaluation.duplicate_rate(found, "doc_id").agg(F.avg("duplicate_rate")).first()[0]
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
        seen = found.groupBy("query_id", "doc_id").agg(F.min("rank").alias("place")).withColumn("place", place)
        hit = queries.select("query_id", "doc_id").join(seen, ["query_id", "doc_id"], "left")
        out[f"mrr_{name}"] = hit.agg(F.avg(F.when(F.col("place") <= 10, 1.0 / F.col("place")).otherwise(0.0))).first()[0]
        found.unpersist()
    return out


STAGES = ("preprocess", "embed", "dense", "bm25", "candidates", "total")


def throughput(engine: Engine, queries: DataFrame, rounds: int = 3) -> list[dict[str, Any]]:
    """Seconds for all queries in one plan, by stage (candidates: all channels and their fusion; total: with reranking), and
    queries a second, after one round that doesn't count."""
    n, label, out = queries.count(), engine.versions().collect()[-1].label, []
    tables, settings = engine._tables(label), engine.config["retrieval"]
    for i in range(rounds + 1):
        row: dict[str, Any] = {"round": i, "queries": n}
        understood = engine.understand(queries)
        encoded = engine.encoder.encode(understood.select("query_id", T.tokens(F.col("dense_text")).alias("tokens")), ["query_id"])
        plans = {
            "preprocess": lambda: understood,  # noqa: B023
            "embed": lambda: encoded,  # noqa: B023
            "dense": lambda: dense.search(tables["vectors"], encoded, settings["dense_top_k"]),  # noqa: B023
            "bm25": lambda: lexical.top_k(lexical.score_stored(tables["postings"], tables["lexicon"], tables["statistics"], Q.term_weights(understood), True), settings["bm25_top_k"]),  # noqa: B023
            "candidates": lambda: engine.candidates(understood, tables, Options()),  # noqa: B023
            "total": lambda: engine.search(queries),
        }
        for name in STAGES:
            began = time.time()
            plans[name]().write.format("noop").mode("overwrite").save()
            row[f"{name}_s"] = round(time.time() - began, 4)
        if i:
            out.append(row | {"queries_per_s": n / row["total_s"]})
    return out


def latency(spark: SparkSession, dataset: Dataset, folder: str, sizes: tuple[int, ...] = (1000, 10_000, 50_000, 100_000), rounds: int = 3) -> Iterator[dict[str, Any]]:
    """A row for each number of documents: seconds to build, and means, medians and 95th percentiles of throughput()."""
    available = dataset.corpus.count()
    for size in sizes:
        if size > available:
            yield {"documents": size, "skipped": f"only {available} documents"}
            continue
        config = load_config(overrides={"index.dir": f"{folder}/{size}"})
        began = time.time()
        index_dataset(spark, dataset.corpus.orderBy(F.xxhash64("doc_id")).limit(size), dataset.name, config)
        row: dict[str, Any] = {"documents": size, "build_s": round(time.time() - began, 2)}
        measured = throughput(Engine(spark, dataset.name, config), dataset.queries, rounds)
        for name in STAGES:
            values = [m[f"{name}_s"] for m in measured]
            row |= {f"{name}_mean_s": float(np.mean(values)), f"{name}_p50_s": float(np.percentile(values, 50)), f"{name}_p95_s": float(np.percentile(values, 95))}
        yield row
