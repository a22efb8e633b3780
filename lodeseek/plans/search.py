"""Search: a table of queries against one version or all, as one plan."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import load_config
from lodeseek.errors import EmptyQueryError, IndexNotFoundError
from lodeseek.functions import query as Q
from lodeseek.functions import text as T
from lodeseek.operators import dedup, dense, fusion, identifiers, ivf, lexical, ranking, versions
from lodeseek.plans.index import Store, checked_versions

#: Candidates, terms and names of a batch of queries that may be sent to all tasks.
SMALL_BATCH = 200_000
#: Queries, and bytes of what is known of them, that the driver may hold.
SMALL_QUERIES, SMALL_BYTES = 10_000, 64_000_000
ABOUT = ("file", "function", "class_name", "start_line", "end_line", "version", "identity", "doc_id", "timestamp")
RESULT = ("query_id", "rank", "score", "file", "function", "class_name", "start_line", "end_line", "version", "method", "why", "also_in", "category", "chunk_id", "identity", "doc_id")


@dataclass(frozen=True)
class Options:
    """What takes part in a search."""

    use_dense: bool = True
    use_bm25: bool = True
    use_identifier: bool = True
    use_query: bool = True
    use_rerank: bool = True
    use_metadata: bool = True
    use_structural: bool = True


PRESETS = {
    "bm25": Options(use_dense=False, use_identifier=False, use_query=False, use_rerank=False),
    "dense": Options(use_bm25=False, use_identifier=False, use_query=False, use_rerank=False),
    "hybrid": Options(use_identifier=False, use_query=False, use_rerank=False),
    "hybrid_identifier": Options(use_query=False, use_rerank=False),
    "reranked": Options(use_query=False, use_metadata=False, use_structural=False),
    "query": Options(use_metadata=False, use_structural=False),
    "metadata": Options(use_structural=False),
    "full": Options(),
}


class Timings:
    """Rows and times of a search's stages, taken while the one plan runs: each stage's rows tell the clock of the task that made
    them.  ``stages()`` has them once the result has been computed; a search over several versions is one plan, so
    its rows are those of all versions."""

    def __init__(self) -> None:
        self.began, self._seen = time.time(), {}

    def watch(self, name: str, rows: DataFrame) -> DataFrame:
        """The same rows, which are observed on their way."""
        self._seen[name] = Observation(name)
        timed = rows.withColumn("_at", F.expr("cast(java_method('java.lang.System', 'currentTimeMillis') as long)"))
        return timed.observe(self._seen[name], F.count("*").alias("rows"), F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_at")

    def driver(self, name: str) -> None:
        """A stage of the driver ends now."""
        self._seen[name] = {"rows": None, "first": self.began * 1000, "last": time.time() * 1000}

    def stages(self) -> list[dict[str, Any]]:
        """Of each stage its rows, and milliseconds from the search's begin to its first and its last row."""
        out = []
        for name, seen in self._seen.items():
            found = seen.get if isinstance(seen, Observation) else seen
            since = lambda x: None if x is None else round(x - self.began * 1000, 1)
            out.append({"stage": name, "rows": found["rows"], "first_ms": since(found["first"]), "last_ms": since(found["last"])})
        return out


class Engine:
    def __init__(self, spark: SparkSession, repository: str, config: dict[str, Any] | None = None, reranker: ranking.TreeReranker | None = None, encoder: dense.Encoder | None = None) -> None:
        """reranker: anything with its rerank(rows, top_n); encoder: the one that the index was made with, if it isn't stored there."""
        self.spark, self.repository, self.config, self.reranker = spark, repository, config or load_config(), reranker
        self.store = Store(spark, self.config["index"]["dir"])
        self._encoder = encoder
        self._kept: DataFrame | None = None

    def versions(self) -> DataFrame:
        """Oldest first."""
        return self.store.versions(self.repository).orderBy("timestamp", "seq")

    @property
    def encoder(self) -> dense.Encoder | None:
        self._encoder = self._encoder or self.store.load_encoder(self.config["embedding_model"])
        return self._encoder

    def queries(self, texts: list[str] | str) -> DataFrame:
        """Numbered queries; one without text is an error."""
        texts = [texts] if isinstance(texts, str) or texts is None else texts
        if not texts or any(not (t or "").strip() for t in texts):
            raise EmptyQueryError("a query without text")
        return self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")

    def understand(self, queries: DataFrame, options: Options = Options()) -> DataFrame:
        """As every channel reads it.  Up to SMALL_QUERIES the rows come to the driver, and further plans start from them; more
        are kept until the next queries come."""
        settings = self.config["query"]
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None
        found = Q.understand(queries, settings["expand_concepts"] and options.use_query, settings["classify"] and options.use_query)
        rows = found.limit(SMALL_QUERIES + 1).toArrow()
        if rows.num_rows <= SMALL_QUERIES and rows.nbytes <= SMALL_BYTES:
            return self.spark.createDataFrame(rows.combine_chunks(), found.schema)
        self._kept = found.persist()
        return self._kept

    def _small(self, understood: DataFrame, versions_: int) -> bool:
        """Whether the batch's candidates, and its terms and names, can go to all tasks; one count for all joins."""
        words = F.size("tokens") + F.size("identifiers") + F.size("expansion") + F.size("entity_names") + F.size("file_names")
        found = understood.agg(F.count("*").alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
        return found.n * self.config["retrieval"]["candidate_size"] * versions_ <= SMALL_BATCH and found.words <= SMALL_BATCH

    def _tables(self, label: str | None, known: list[Row] | None = None) -> dict[str, Any]:
        """The tables of a version or of all, and under statistics what BM25 needs to know of each.  known: the rows of versions()."""
        names = ("chunks", "postings", "lexicon", "identifiers", "vectors")
        own = {n: self.store.read(n).filter(F.col("repository") == self.repository) for n in names}
        found = own if label is None else {n: df.filter(F.col("version") == label) for n, df in own.items()}
        known = self.versions().collect() if known is None else known  # a row a version
        return found | {"statistics": [lexical.Statistics(r.label, r.n_chunks, r.avgdl, r.buckets) for r in known if label in (None, r.label)]}

    def _nearest(self, tables: dict[str, Any], asked: DataFrame, k: int) -> DataFrame:
        """Exact; or, of a single version that has one, by its inverted file."""
        labels = [a.version for a in tables["statistics"]]
        if self.config["vector_index"]["ann"] == "ivf" and len(labels) == 1:
            part = self.store.cells(self.repository, labels[0])
            if self.store.exists(part.removeprefix(f"{self.store.folder}/")):
                return ivf.search(ivf.load(self.spark, part), self.spark, asked, k)
        return dense.search(tables["vectors"], asked, k)

    def candidates(self, understood: DataFrame, tables: dict[str, Any], options: Options, versions_: int = 1, small: bool = False, whole: bool = False, timings: Timings | None = None) -> DataFrame:
        """whole: all that a channel found, without a cut of the fused list.  Over several versions each channel gives so many times its candidates: a unit has a copy in each at most, so that
        as many units come as from one version."""
        settings = self.config["retrieval"]
        channels: dict[str, DataFrame] = {}
        if options.use_dense:
            asked = self.encoder.encode(understood.select("query_id", T.tokens(F.col("dense_text")).alias("tokens")), ["query_id"])
            channels["dense"] = self._nearest(tables, asked, settings["dense_top_k"] * versions_).filter("score > 0")
        if options.use_bm25:
            channels["bm25"] = lexical.top_k(lexical.score_stored(tables["postings"], tables["lexicon"], tables["statistics"], Q.term_weights(understood), small), settings["bm25_top_k"] * versions_)
        if options.use_identifier:
            channels["identifier"] = lexical.top_k(identifiers.search(tables["identifiers"], understood, small), settings["identifier_top_k"] * versions_)
        if timings is not None:
            channels = {name: timings.watch(name, found) for name, found in channels.items()}
        on = (options.use_dense, options.use_bm25, options.use_identifier)
        base = tuple(settings[f"{c}_weight"] for c in fusion.CHANNELS)
        weighed = understood.select("query_id", Q.channel_weights(F.col("category"), base, on, settings["category_weights"]).alias("weights"))
        fused = fusion.fuse(fusion.gather(channels), weighed, 2**31 - 1 if whole else settings["candidate_size"] * versions_, settings["fusion"], small)
        return timings.watch("candidates", fused) if timings is not None else fused

    def featured(self, understood: DataFrame, tables: dict[str, Any], options: Options, keep: tuple[str, ...] = (), versions_: int = 1, whole: bool = False, timings: Timings | None = None) -> DataFrame:
        small = self._small(understood, versions_) and not whole
        found = self.candidates(understood, tables, options, versions_, small, whole, timings)
        return ranking.features(found, tables["chunks"], understood, options.use_structural and self.config["ranking"]["use_structural"], keep, small)

    def _ranked(self, understood: DataFrame, tables: dict[str, Any], options: Options, keep: tuple[str, ...], versions_: int, timings: Timings | None = None) -> DataFrame:
        rows, settings = self.featured(understood, tables, options, keep, versions_, timings=timings), self.config["ranking"]
        top_n = settings["rerank_top_n"] * versions_
        if not options.use_rerank or settings["reranker"] == "none":
            return rows
        if self.reranker is not None:
            return self.reranker.rerank(rows, top_n)
        weights = {f: w for f, w in settings["weights"].items() if (options.use_metadata or f != "metadata") and (options.use_structural or f != "structural")}
        return ranking.rerank(rows, ranking.linear_score(weights), top_n)

    def search(self, queries: DataFrame, version: str | None = None, top_k: int = 10, options: Options = Options(), history: bool = False, timings: Timings | None = None, candidate_k: int | None = None) -> DataFrame:
        """queries: query_id and text (and forced_category).  timings: observes the stages of this search.  candidate_k: candidates
        of each channel and of their fusion, in place of the settings'.  version: as versions.resolve takes it, or "all",
        which ranks the units of all versions together and, unless history, collapses those of one unit."""
        if top_k < 1 or candidate_k is not None and candidate_k < 1:
            raise ValueError("top_k or candidate_k is less than 1")
        if candidate_k is not None:
            sizes = dict.fromkeys(("dense_top_k", "bm25_top_k", "identifier_top_k", "candidate_size"), candidate_k)
            own = Engine(self.spark, self.repository, {**self.config, "retrieval": {**self.config["retrieval"], **sizes}}, self.reranker, self._encoder)
            return own.search(queries, version, top_k, options, history, timings)
        whole, known = version == "all", self.versions().collect()  # a row a version
        label = None if whole else versions.resolve(known, version)
        searched = [row for row in known if whole or row.label == label]
        checked_versions(searched, self.encoder)
        tables = self._tables(label, known)
        understood = self.understand(queries, options)
        if timings is not None:
            timings.driver("preprocess")
        collapsed = whole and not history and self.config["dedup"]["enabled"]
        rows = self._ranked(understood, tables, options, (*ABOUT, "code") if collapsed else ABOUT, len(searched), timings).join(understood.select("query_id", "category"), "query_id")
        rows = rows.withColumn("also_in", F.array().cast("array<string>"))
        if collapsed:
            carried = rows.drop("also_in").join(tables["vectors"].select("chunk_id", "vector"), "chunk_id")
            rows = dedup.collapse_versions(carried, self.config["dedup"]["similarity_threshold"])
        placed = versions.merge_ranked(rows, top_k) if whole else rows.filter(F.col("rank") <= top_k)
        why = F.concat(F.lit("["), F.col("category"), F.lit("] "), ranking.explanation())
        found = placed.withColumn("method", fusion.method()).withColumn("why", why).select(*RESULT)
        return timings.watch("results", found) if timings is not None else found

    def run(self, queries: DataFrame, top_k: int = 100, options: Options = Options()) -> DataFrame:
        """query_id, doc_id and score, the best of each document; for evaluation."""
        found = self.search(queries, None, top_k, options)
        return found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def retrieve(spark: SparkSession, query: str, repository: str, version: str | None = None, top_k: int = 10, config: dict[str, Any] | None = None) -> DataFrame:
    engine = Engine(spark, repository, config)
    if engine.versions().isEmpty():
        raise IndexNotFoundError(f"{repository} is not indexed")
    return engine.search(engine.queries(query), version, top_k)


def weight_trials(featured: DataFrame, trials: DataFrame, features: list[str]) -> DataFrame:
    """trials: trial and a weight for each feature.  query_id, chunk_id, trial, score of all trials in one plan
    over the features, which are computed once."""
    score: Column = sum((F.col(f"t.{f}") * F.col(f"f.{f}") for f in features), F.lit(0.0))
    pairs = featured.alias("f").crossJoin(F.broadcast(trials.alias("t")))  # some tens of trials
    return pairs.select("f.query_id", "f.chunk_id", "t.trial", score.alias("score"))
