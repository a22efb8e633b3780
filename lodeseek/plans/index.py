"""The stored index: Parquet tables, partitioned by repository and version, and how they are built.

Tables under one folder: chunks (with the tokens of both texts), identifiers, vectors, postings (by a hash of the term too) and
the lexicon of document frequencies by version; versions and version_files; and two caches, of parsed files by content and of vectors by unit.  A new version reuses the
chunks of unchanged files, takes parsed files from the cache, and encodes only units without a vector."""

from __future__ import annotations

import json
import time
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import load_config
from lodeseek.errors import IndexNotFoundError, LodeseekError, MissingEmbeddingsError
from lodeseek.functions import text as T
from lodeseek.functions.schemas import CACHE, CHUNK_FIELDS, CHUNKS, VERSIONS
from lodeseek.operators import identifiers, ivf, lexical, ranking, versions
from lodeseek.operators.dense import Encoder, LsaEncoder, load_encoder
from lodeseek.sources import git_source
from lodeseek.sources.chunker import chunk_files, document_chunks
from lodeseek.sources.repository import WORKTREE, Snapshot, has_commit, list_files, read_files, supported, take_snapshot
from lodeseek.sources.scan import spread

PARTS = ("repository", "version")


class Store:
    """The tables of one index folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def exists(self, table: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        if not self.exists(table):
            if schema is None:
                raise IndexNotFoundError(f"no table {table} in {self.folder}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.folder}/{table}")

    def put(self, df: DataFrame, table: str, *more: str) -> DataFrame:
        """Replaces the versions that df has rows of, and no others.  more: columns that part a version's rows."""
        if more and self.exists(table):  # folders of the version that df has no rows for must go too
            for row in df.select(*PARTS).limit(1).collect():
                self.drop_version(table, *row)
        df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS, *more).mode("overwrite").parquet(f"{self.folder}/{table}")
        return self.read(table)

    def _part(self, repository: str, label: str) -> str:
        names = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return "/".join(names.getPartitionPathString(c, v) for c, v in zip(PARTS, (repository, label), strict=True))

    def cells(self, repository: str, label: str) -> str:
        """The folder of a version's inverted file, if it has one."""
        return f"{self.folder}/cells/{self._part(repository, label)}"

    def drop_version(self, table: str, repository: str, label: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{self._part(repository, label)}")
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def append(self, df: DataFrame, table: str, *parts: str) -> None:
        df.write.mode("append").partitionBy(*parts).parquet(f"{self.folder}/{table}")

    def version(self, table: str, repository: str, label: str) -> DataFrame:
        """Reads that version's partition alone."""
        return self.read(table).filter((F.col("repository") == repository) & (F.col("version") == label))

    def versions(self, repository: str | None = None) -> DataFrame:
        rows = self.read("versions", VERSIONS)
        rows = rows.groupBy("repository", "label").agg(F.max_by(F.struct(*(f.name for f in rows.schema)), "seq").alias("v")).select("v.*")
        return rows if repository is None else rows.filter(F.col("repository") == repository)

    def save_encoder(self, encoder: LsaEncoder) -> None:
        if not isinstance(encoder, LsaEncoder):
            return
        rows = [(t, float(encoder.idf[i]), [float(x) for x in encoder.projection[i]]) for t, i in encoder.terms.items()]
        self.spark.createDataFrame(rows, "term string, idf double, loading array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/encoder")

    def load_encoder(self, settings: dict) -> LsaEncoder | None:
        if not self.exists("encoder"):
            return None
        rows = self.read("encoder").orderBy(F.desc("idf"), "term").collect()  # max_terms rows at most
        encoder = load_encoder(settings)
        encoder.terms = {r.term: i for i, r in enumerate(rows)}
        encoder.idf = np.array([r.idf for r in rows])
        encoder.projection = np.array([r.loading for r in rows])
        encoder.dim = encoder.projection.shape[1] if rows else 1
        return encoder


def with_keys(chunks: DataFrame, mode: str) -> DataFrame:
    """Adds names, keys, an id that depends on the unit, its version and its place, and tokens."""
    named = chunks.withColumns({"qualname": T.qualname(), "identity": T.identity(), "cache_key": T.cache_key(), "tokens": T.tokens(T.lexical_text(mode)), "dense_tokens": T.tokens(T.representation(mode)), **ranking.feature_words()})
    return named.withColumn("chunk_id", F.xxhash64("repository", "version", "identity", "chash", "start_line", "doc_id"))


PARSE_CACHE = "repository string, blob string, max_lines int, " + ", ".join(f"u_{f}" for f in CHUNK_FIELDS.split(", "))


def _parsed(store: Store, state: Snapshot, todo: DataFrame, settings: dict, label: str) -> tuple[DataFrame, dict]:
    """Chunks of the files in todo, by way of the cache of parsed contents, of which this repository's part is read."""
    height = settings["max_chunk_lines"]

    def cached() -> DataFrame:
        return store.read("parse_cache", PARSE_CACHE).filter((F.col("repository") == state.name) & (F.col("max_lines") == height))

    misses = todo.join(cached().select("blob").distinct(), "blob", "left_anti").cache()
    counts = {"files_parsed": misses.count()}
    fresh = chunk_files(read_files(state, misses), state.name, state.commit, label, state.timestamp, height, settings["max_file_bytes"])
    keyed = fresh.join(misses.select(F.col("path").alias("file"), "blob"), "file")
    names = [f.split()[0] for f in CHUNK_FIELDS.split(", ")]
    store.append(keyed.select(F.lit(state.name).alias("repository"), "blob", F.lit(height).alias("max_lines"), *(F.col(n).alias(f"u_{n}") for n in names)), "parse_cache", "repository")
    misses.unpersist()
    wanted = cached().join(todo.select("blob").distinct(), "blob", "left_semi")
    one = wanted.groupBy("blob").agg(F.min("u_file").alias("u_file"))  # equal contents were parsed under one name
    whole = wanted.join(one, ["blob", "u_file"]).dropDuplicates(["blob", "u_start_line", "u_kind", "u_part", "u_class_name", "u_function"])
    units = todo.join(whole, "blob").select("path", *(F.col(f"u_{n}").alias(n) for n in names))
    current = units.withColumns({"file": F.col("path"), "commit": F.lit(state.commit), "version": F.lit(label), "timestamp": F.lit(state.timestamp)}).drop("path")
    return current.withColumn("chash", T.content_hash(F.col("code"))).withColumn("doc_id", F.lit("")), counts


def _base_version(known: DataFrame, label: str, commit: str, asked: str | None) -> Row | None:
    """The version that chunks are reused of: the one asked for, else the newest other one."""
    if asked is not None:
        row = known.filter((F.col("label") == asked) & (F.col("label") != label)).first()
        if row is None:
            raise IndexNotFoundError(f"no other version {asked!r} to start from")
        return row
    return known.filter((F.col("label") != label) & (F.col("commit") != commit)).orderBy(F.desc("timestamp"), F.desc("seq")).first()


def index_repository(
    spark: SparkSession, repo_path: str, commit: str | None = None, label: str | None = None, config: dict[str, Any] | None = None, full: bool = False, base: str | None = None, encoder: Encoder | None = None
) -> dict[str, Any]:
    """Indexes a folder or a commit; returns counters.  full: reuses no chunks of other versions; base: the version to reuse
    chunks of; encoder: in place of that of the settings."""
    config = config or load_config()
    began, settings, mode = time.time(), config["chunking"], config["representation"]
    state = take_snapshot(repo_path, commit)
    label = label or state.label
    store = Store(spark, config["index"]["dir"])
    files = list_files(spark, state).cache()
    fitting = supported(files).cache()
    small = fitting.filter(F.col("size") <= settings["max_file_bytes"])
    stats: dict[str, Any] = {"files_total": files.count(), "files_supported": fitting.count()}
    stats |= {"files_unsupported": stats["files_total"] - stats["files_supported"], "files_large": stats["files_supported"] - small.count()}
    if not stats["files_supported"]:
        raise LodeseekError(f"no source files in {repo_path}")
    before = None if full else _base_version(store.versions(state.name), label, state.commit, base)
    if before is not None:
        changes = versions.diff(store.version("version_files", state.name, before.label).select("path", "blob"), fitting)
        if WORKTREE not in (state.commit, before.commit) and has_commit(state, before.commit):
            changes = versions.all_changes(changes, git_source.changes(spark, state.folder, before.commit, state.commit))
        old = store.version("chunks", state.name, before.label).select(*(f.split()[0] for f in CHUNKS.split(", ")))
        reused = versions.reused_chunks(old, fitting, changes, state.commit, label, state.timestamp)
        todo = small.join(changes.select("path"), "path", "left_semi")
    else:
        reused, todo = None, small
    parsed, counts = _parsed(store, state, todo, settings, label)
    stats |= counts | {"base": before.label if before else None, "files_changed": todo.count(), "chunks_reused": reused.count() if reused is not None else 0}
    stats["files_from_cache"] = stats["files_changed"] - stats["files_parsed"]
    whole = parsed if reused is None else parsed.unionByName(reused)
    stored = store.put(with_keys(whole, mode), "chunks").filter((F.col("repository") == state.name) & (F.col("version") == label))
    stats["files_without_chunks"] = small.count() - stored.select("file").distinct().count()
    stats |= _finish(store, stored, state.name, label, config, encoder)
    part = lambda df: df.withColumns({"repository": F.lit(state.name), "version": F.lit(label)})
    store.put(part(fitting), "version_files")
    row = (state.name, label, state.commit, state.timestamp, stats["chunks"], stats["embedder"], mode, stats["base"], int(time.time() * 1e6), stats.pop("avgdl"), stats.pop("buckets"))
    store.append(spark.createDataFrame([row], VERSIONS), "versions")
    for table in (files, fitting):
        table.unpersist()
    return stats | {"label": label, "commit": state.commit, "seconds": time.time() - began}


def _finish(store: Store, chunks: DataFrame, repository: str, label: str, config: dict[str, Any], encoder: Encoder | None = None) -> dict[str, Any]:
    """Vectors, postings and identifiers of stored chunks."""
    settings, mode = config["embedding_model"], config["representation"]
    texts = chunks.select("chunk_id", "cache_key", F.col("dense_tokens").alias("tokens"))
    encoder = encoder or store.load_encoder(settings)
    if encoder is None:
        encoder = load_encoder(settings).fit(texts)
        store.save_encoder(encoder)
        encoder = store.load_encoder(settings) or encoder
    name = encoder.model_version
    cache = store.read("embedding_cache", CACHE).filter((F.col("repository") == repository) & (F.col("model_version") == name) & (F.col("representation") == mode) & (F.size("vector") == encoder.dim))
    missing = texts.join(cache, "cache_key", "left_anti").dropDuplicates(["cache_key"])
    counts = {"chunks": chunks.count(), "embeddings_computed": missing.count()}
    fresh = encoder.encode(missing, ["cache_key"])
    store.append(fresh.select(F.lit(repository).alias("repository"), F.lit(name).alias("model_version"), F.lit(mode).alias("representation"), "cache_key", "vector"), "embedding_cache", "repository")
    again = store.read("embedding_cache", CACHE).filter((F.col("repository") == repository) & (F.col("model_version") == name) & (F.col("representation") == mode) & (F.size("vector") == encoder.dim))
    vectors = texts.select("chunk_id", "cache_key").join(again.groupBy("cache_key").agg(F.first("vector").alias("vector")), "cache_key").select("chunk_id", "vector")
    part = lambda df: df.withColumns({"repository": F.lit(repository), "version": F.lit(label)})
    store.put(part(vectors), "vectors")
    wanted = config["vector_index"]
    store.drop_version("cells", repository, label)
    if wanted["ann"] == "ivf" and counts["chunks"] > wanted["flat_threshold"]:
        ivf.build(store.version("vectors", repository, label), store.cells(repository, label), recall=wanted["recall"])
    sizes = lexical.corpus_statistics(chunks.select("tokens")).first()
    buckets = max(1, min(lexical.MOST_BUCKETS, round(sizes.n * (sizes.avgdl or 0)) // lexical.TOKENS_PER_BUCKET))
    store.put(part(lexical.bucketed(lexical.counted_in_rows(chunks.select("chunk_id", "tokens")), buckets)), "postings", "bucket")
    frequencies = store.version("postings", repository, label).groupBy("bucket", "term").agg(F.count("*").alias("df"))
    store.put(part(frequencies.sortWithinPartitions("bucket", "term")), "lexicon", "bucket")
    store.put(part(identifiers.build(chunks)), "identifiers")
    return counts | {"embeddings_cached": counts["chunks"] - counts["embeddings_computed"], "embedder": name, "avgdl": sizes.avgdl, "buckets": buckets}


def index_dataset(spark: SparkSession, corpus: DataFrame, name: str, config: dict[str, Any] | None = None, version: str = "v1", encoder: Encoder | None = None) -> dict[str, Any]:
    """corpus: doc_id, text and, if there is one, chunk; each document a unit with the names that chunker.document_chunks finds."""
    config = config or load_config()
    chunks = document_chunks(spread(corpus.select("doc_id", "text", *(["chunk"] if "chunk" in corpus.columns else []))))
    fixed = {"repository": F.lit(name), "version": F.lit(version), "timestamp": F.lit(0.0)}
    return index_chunks(spark, chunks.withColumns(fixed), name, version, config, encoder=encoder)


def index_chunks(spark: SparkSession, chunks: DataFrame, name: str, version: str, config: dict[str, Any], timestamp: float = 0.0, encoder: Encoder | None = None) -> dict[str, Any]:
    """chunks: the columns of a stored chunk, of one repository and version."""
    store = Store(spark, config["index"]["dir"])
    stored = store.put(with_keys(chunks, config["representation"]), "chunks").filter((F.col("repository") == name) & (F.col("version") == version))
    stats = _finish(store, stored, name, version, config, encoder)
    row = (name, version, version, timestamp, stats["chunks"], stats["embedder"], config["representation"], None, int(time.time() * 1e6), stats.pop("avgdl"), stats.pop("buckets"))
    store.append(spark.createDataFrame([row], VERSIONS), "versions")
    return stats | {"label": version}


def checked_versions(rows: list[Row], encoder: Encoder | None) -> None:
    """An index of another encoder can't be searched."""
    for row in rows:
        if encoder is None or row.embedder != encoder.model_version:
            raise MissingEmbeddingsError(f"{row.label} was encoded by {row.embedder}")


def write_report(path: str, rows: list[dict[str, Any]]) -> None:
    """The same rows as JSON and, beside it, as a Markdown table."""
    rows = [{k: round(v, 4) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    Path(path).write_text(json.dumps(rows, indent=1))
    names = list(dict.fromkeys(k for r in rows for k in r))
    lines = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(str(r.get(n, "")) for n in names) + " |" for r in rows)]
    Path(path).with_suffix(".md").write_text("\n".join(lines) + "\n")
