"""What changed between versions, what can be reused, and which version is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodeseek.errors import IndexNotFoundError


def diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """Both: path and blob.  path and change: added, deleted or modified; unchanged paths are left out."""
    a, b = base.select("path", F.col("blob").alias("old")), now.select("path", F.col("blob").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def all_changes(by_blob: DataFrame, by_git: DataFrame) -> DataFrame:
    """Both: path and change.  Each path that either has; where they differ, what the contents say counts."""
    own, other = by_blob.select("path", "change"), by_git.select("path", F.col("change").alias("told"))
    return own.join(other.groupBy("path").agg(F.min("told").alias("told")), "path", "full").select("path", F.coalesce("change", "told").alias("change"))


def reused_chunks(chunks: DataFrame, now: DataFrame, changes: DataFrame, commit: str, version: str, timestamp: float) -> DataFrame:
    """Chunks of the base version whose files are still there and unchanged, under the new version's name."""
    kept = chunks.join(now.select(F.col("path").alias("file")), "file", "left_semi").join(changes.select(F.col("path").alias("file")), "file", "left_anti")
    return kept.withColumns({"commit": F.lit(commit), "version": F.lit(version), "timestamp": F.lit(float(timestamp))}).select(*chunks.columns)


def cache_hits(asked: DataFrame, cache: DataFrame, keys: list[str], value: str, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """asked with the cached value, and the rows of asked without one.  Entries that aren't valid are misses."""
    stored = cache.filter(valid) if valid is not None else cache
    stored = stored.groupBy(*keys).agg(F.first(value, ignorenulls=True).alias(value))
    return asked.join(stored, keys), asked.join(stored, keys, "left_anti")


def latest(versions: DataFrame) -> DataFrame:
    """versions: label, commit, timestamp, seq (order of registration).  The newest of each repository, of
    equal times the last registered."""
    return versions.groupBy("repository").agg(F.max_by(F.struct("label", "commit", "timestamp"), F.struct("timestamp", "seq")).alias("v")).select("repository", "v.*")


def resolve(rows: list[Row], asked: str | None) -> str:
    """rows: versions with label and commit, oldest first.  A label, a commit or a commit's beginning to the label; nothing,
    latest or HEAD to the newest."""
    if not rows:
        raise IndexNotFoundError("nothing is indexed")
    if asked in (None, "", "latest", "HEAD"):
        return rows[-1].label
    for test in (lambda r: r.label == asked, lambda r: r.commit == asked, lambda r: bool(r.commit) and r.commit.startswith(asked)):
        for row in rows:
            if test(row):
                return row.label
    raise IndexNotFoundError(f"no version {asked!r} is indexed; there are {', '.join(r.label for r in rows)}")


def merge_ranked(results: DataFrame, k: int) -> DataFrame:
    """Results of several versions (score, timestamp of the version, rank there) to one list of k."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "timestamp", "rank", "chunk_id")
    merged = results.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return merged.drop("rank").withColumnRenamed("_place", "rank")


def _first_replaced(text: Column, before: str, literal: Column, after: str, new: Column) -> Column:
    """text with new in the place of its first match of the literal between two patterns."""
    pattern = F.concat(F.lit(rf"(?s)\A(.*?{before})\Q"), literal, F.lit(rf"\E{after}"))
    return F.regexp_replace(text, pattern, F.concat(F.lit("$1"), new))


def refactored(chunks: DataFrame, share: Column) -> DataFrame:
    """A made-up next version: units for which share holds get another name, where it is defined first and in the
    signature, and a comment."""
    from lodeseek.functions.text import content_hash

    old = F.col("function")
    name = F.concat(F.lit("refactored_"), old)
    test = share & (F.coalesce("function", F.lit("")) != "")
    changed = {
        "code": F.concat(_first_replaced(F.col("code"), r"\bdef ", old, r"\b", name), F.lit("\n# refactored")),
        "signature": _first_replaced(F.col("signature"), "", old, "", name),
        "function": name,
    }
    rows = chunks.withColumns({c: F.when(test, new).otherwise(F.col(c)) for c, new in changed.items() if c in chunks.columns})
    return rows.withColumn("chash", content_hash(F.col("code")))
