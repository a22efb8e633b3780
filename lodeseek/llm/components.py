"""Connected components of a graph given as a table of links, without gathering it anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014).  Every step is two aggregations or joins on node ids; each round is written to
the shared folder, which cuts the lineage.  The centre of a giant component has a row for each of its members:
from ``MANY_LINKS`` on, such nodes are joined without being dealt by their id.

Defined results: loops, repeated links and links with a null are ignored; an empty table has no components; more
columns than u and v aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.shared import join_counted, stash


#: Fewer rows may meet in a task, whatever their key.
MANY_LINKS = 100_000


def _with_least(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """rows joined on u with least: u, m and n, the number of rows of u."""
    if links < MANY_LINKS:
        return rows.join(least.drop("n"), "u")
    return join_counted(rows, stash(least, "least"), "u", "n", links)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    return _with_least(both.filter("v > u"), least, links).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, links).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns u and v (long).  Returns u and root, the smallest node of its component, for
    each node that isn't a root itself.  Loops, repeated links and nulls are ignored."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stash(edges.distinct(), "links")
    before = _state(edges)
    while before[0]:
        large = _large_star(edges, before[0]).distinct()
        if before[0] >= MANY_LINKS:
            large = stash(large, "links")
        edges = stash(_small_star(large, before[0]).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select("u", F.col("v").alias("root"))
