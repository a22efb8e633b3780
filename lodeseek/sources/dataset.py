"""Retrieval datasets: a corpus, queries and judgements, read from and written to a folder."""

from __future__ import annotations

import ast
import textwrap
import uuid
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import text as T
from lodeseek.functions.schemas import CHUNK_FIELDS
from lodeseek.sources.chunker import chunk_files
from lodeseek.sources.repository import folder_snapshot, list_files, read_files

#: Larger files aren't taken into a benchmark.
MOST_BYTES = 200_000


class Dataset(NamedTuple):
    name: str
    corpus: DataFrame  # doc_id, text and, if it was stored, chunk: a struct of a chunk's fields, or null
    queries: DataFrame  # query_id, text
    qrels: DataFrame  # query_id, doc_id, rel


CHUNK_STRUCT = ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in CHUNK_FIELDS.split(", ")))


def _path(spark: SparkSession, path: str):
    """A path and its file system, of any kind that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    place, system = _path(spark, path)
    return system.exists(place)


def read_dataset(spark: SparkSession, folder: str) -> Dataset:
    """corpus.jsonl and queries.jsonl, each a file or a folder of files, and qrels.jsonl with a judgement a line, or qrels.json
    with a map for each query.  folder: any path that Spark reads.  A missing part is a FileNotFoundError."""
    folder = folder.rstrip("/")
    long = _exists(spark, f"{folder}/qrels.jsonl")
    for name in ("corpus.jsonl", "queries.jsonl", "qrels.jsonl" if long else "qrels.json"):
        if not _exists(spark, f"{folder}/{name}"):
            raise FileNotFoundError(f"{folder}/{name}")
    read = lambda name, schema: spark.read.schema(f"id string, text string{schema}").json(f"{folder}/{name}")
    corpus = read("corpus.jsonl", f", chunk struct<{CHUNK_STRUCT}>").select(F.col("id").alias("doc_id"), "text", "chunk")
    queries = read("queries.jsonl", "").select(F.col("id").alias("query_id"), "text")
    if long:
        qrels = spark.read.schema("query_id string, doc_id string, rel int").json(f"{folder}/qrels.jsonl")
    else:
        judged = spark.read.text(f"{folder}/qrels.json", wholetext=True).select(F.from_json("value", "map<string,map<string,int>>").alias("m"))
        qrels = judged.select(F.explode("m").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "rel"))
    return Dataset(_path(spark, folder)[0].getName() if not folder.startswith(".") else Path(folder).resolve().name, corpus, queries, qrels)


def write_dataset(dataset: Dataset, folder: str) -> None:
    """Three folders of JSON lines, written by the tasks that have the rows, whatever their number.  They are written beside the
    named folder and take its name together, so a reader sees the whole or nothing; what was there before goes."""
    spark, folder = dataset.corpus.sparkSession, folder.rstrip("/")
    unfinished = f"{folder}.unfinished-{uuid.uuid4().hex}"
    for name, df, id_ in (("corpus.jsonl", dataset.corpus, "doc_id"), ("queries.jsonl", dataset.queries, "query_id")):
        fields = [F.col(id_).cast("string").alias("id"), "text", *(["chunk"] if "chunk" in df.columns else [])]
        df.select(*fields).write.json(f"{unfinished}/{name}")
    judged = dataset.qrels.select(*(F.col(c).cast("string") for c in ("query_id", "doc_id")), F.col("rel").cast("int"))
    judged.write.json(f"{unfinished}/qrels.jsonl")
    target, system = _path(spark, folder)
    system.delete(target, True)
    if target.getParent() is not None:
        system.mkdirs(target.getParent())
    if not system.rename(_path(spark, unfinished)[0], target):
        raise OSError(f"{unfinished} can't be renamed to {folder}")


def titled(corpus: DataFrame) -> DataFrame:
    """doc_id and text of rows with a title: title, line end, text, without white space around."""
    return corpus.select(F.col("doc_id").cast("string").alias("doc_id"), F.regexp_replace(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))), r"^\s+|\s+$", "").alias("text"))


def last_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, text: a conversation's query is what was said last."""
    return conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def without_docstring(code: str) -> str:
    """The code of a function less the lines of its documentation; code that can't be parsed as it is."""
    try:
        head = ast.parse(textwrap.dedent(code)).body[0].body[0]
    except (SyntaxError, ValueError, AttributeError, IndexError, RecursionError):
        return code
    match head:
        case ast.Expr(value=ast.Constant(value=str())):
            lines = code.splitlines()
            return "\n".join(lines[: head.lineno - 1] + lines[head.end_lineno :])
    return code


def _bare(code: pd.Series) -> pd.Series:
    return code.map(without_docstring)


def functions_in_folders(spark: SparkSession, folders: list[str], limit: int, seed: int = 0) -> DataFrame:
    """Different functions of 3 to 60 lines in the folders' Python files, as chunks whose code has no documentation; limit
    of them by a hash.  Functions that differ in their documentation alone are one."""
    found = None
    for state in map(folder_snapshot, folders):
        files = list_files(spark, state).filter(F.col("path").endswith(".py") & (F.col("size") <= MOST_BYTES))
        named = read_files(state, files).withColumn("file", T.short_path(F.col("file")))
        own = chunk_files(named, state.name, state.commit, state.label)
        found = own if found is None else found.unionByName(own)
    bare = F.pandas_udf(_bare, "string")("code")
    units = fitting_functions(found.withColumn("code", bare)).withColumn("chash", T.content_hash(F.col("code"))).withColumn("doc_id", F.col("chash"))
    return units.dropDuplicates(["chash"]).orderBy(F.xxhash64("chash", F.lit(seed))).limit(limit)


def fitting_functions(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("kind").isin("function", "method") & (F.col("end_line") - F.col("start_line") + 1).between(3, 60) & (F.length("code") >= 40))


def benchmark_of(chunks: DataFrame, queries: int, seed: int = 0) -> Dataset:
    """A dataset from documented functions: the first sentence of the documentation asks for the function, whose text and
    stored chunk have no documentation.  Questions that differ in case alone are one."""
    bare = F.pandas_udf(_bare, "string")("code")
    units = fitting_functions(chunks.withColumn("code", bare)).withColumn("chash", T.content_hash(F.col("code"))).withColumn("doc_id", F.col("chash"))
    units = units.withColumn("asked", T.first_sentence(F.col("doc"))).dropDuplicates(["chash"])
    low, words = F.lower("asked"), F.size(F.split("asked", " "))
    fitting = units.filter(words.between(6, 30) & ~low.startswith("return self") & ~low.startswith("see ")).withColumn("low", low)
    chosen = fitting.dropDuplicates(["low"]).orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(queries)
    named = chosen.select(F.concat(F.lit("q"), "doc_id").alias("query_id"), F.col("asked").alias("text"), "doc_id")
    fields = [F.lit("").alias("doc") if name == "doc" else F.col(name) for name in (f.split()[0] for f in CHUNK_FIELDS.split(", "))]
    corpus = units.select("doc_id", F.col("code").alias("text"), F.struct(*fields).alias("chunk"))
    return Dataset("functions", corpus, named.select("query_id", "text"), named.select("query_id", "doc_id", F.lit(1).alias("rel")))
