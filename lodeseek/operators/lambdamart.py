"""Listwise reranking: boosted trees whose gradients are swaps within a query, weighed by what they do to nDCG (Burges, 2010).

Every step is a Spark aggregation.  Candidates are dealt by query once; a window over a query, of which there are at most as
many candidates as a search gives, makes each candidate's gradient and second derivative.  A tree grows level by level: one
aggregation a level sums both by node, feature and bin, which are few, and the driver picks the splits from these sums.
Scores are expressions over the features, so a lost executor costs only what it held."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators import ranking


def discount(rank: Column, k: int) -> Column:
    """1 / log2(1 + rank) down to rank k, then 0."""
    return F.when(rank <= k, 1.0 / F.log2(rank.cast("double") + 1)).otherwise(0.0)


def with_ideal(rows: DataFrame, label: str, k: int) -> DataFrame:
    """Adds ideal: the DCG at k of a query's candidates in their best order."""
    group = Window.partitionBy("query_id")
    best = F.row_number().over(group.orderBy(F.desc(label), "chunk_id"))
    return rows.withColumn("_best", best).withColumn("ideal", F.sum(F.col(label) * discount(F.col("_best"), k)).over(group)).drop("_best")


def lambdas(rows: DataFrame, label: str = "label", score: str = "score", k: int = 10) -> DataFrame:
    """rows: query_id, chunk_id, a label of 0 or more, a score and ideal (of with_ideal).  Adds gradient, by which
    a candidate should rise, and curvature, summed over the candidates of its query with another label:
    rho = 1 / (1 + exp(higher's score - lower's)) times the change of nDCG at k that swapping the two makes.  Queries
    without a relevant candidate have none."""
    group = Window.partitionBy("query_id")
    placed = rows.withColumn("_discount", discount(F.row_number().over(group.orderBy(F.desc(score), "chunk_id")), k))
    others = F.collect_list(F.struct(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"), F.col("_discount").alias("discount"))).over(group)
    own = F.col(label).cast("double")

    def step(total: Column, other: Column) -> Column:
        better = own > other["label"]
        apart = F.when(better, F.col(score) - other["score"]).otherwise(other["score"] - F.col(score))
        rho = 1.0 / (1.0 + F.exp(apart))
        change = F.abs((own - other["label"]) * (F.col("_discount") - other["discount"]))
        gradient = total["gradient"] + F.when(better, rho * change).otherwise(-rho * change)
        return F.when(own == other["label"], total).otherwise(F.struct(gradient.alias("gradient"), (total["curvature"] + rho * (1.0 - rho) * change).alias("curvature")))

    summed = F.aggregate("_others", F.struct(F.lit(0.0).alias("gradient"), F.lit(0.0).alias("curvature")), step)
    found = placed.withColumn("_others", others).withColumn("_sum", F.when(F.col("ideal") > 0, summed))
    part = lambda name: F.coalesce(F.col(f"_sum.{name}") / F.col("ideal"), F.lit(0.0)).alias(name)
    return found.select("*", part("gradient"), part("curvature")).drop("_others", "_sum", "_discount")


@dataclass(frozen=True)
class Split:
    feature: str
    edge: float  # rows up to it go left
    left: Split | float
    right: Split | float

    def column(self) -> Column:
        side = lambda x: x.column() if isinstance(x, Split) else F.lit(float(x))
        return F.when(F.coalesce(F.col(self.feature), F.lit(0.0)) <= F.lit(self.edge), side(self.left)).otherwise(side(self.right))


class ListwiseReranker:
    """LambdaMART over ranking.FEATURES."""

    def __init__(self, k: int = 10, learning_rate: float = 0.2, bins: int = 32, smoothing: float = 1.0, least_rows: int = 5) -> None:
        self.k, self.learning_rate, self.bins, self.smoothing, self.least_rows = k, learning_rate, bins, smoothing, least_rows
        self.trees: list[Split | float] | None = None

    def score(self) -> Column:
        """The sum over all trees."""
        if self.trees is None:
            raise RuntimeError("the reranker is not trained")
        return sum((t.column() if isinstance(t, Split) else F.lit(float(t)) for t in self.trees), F.lit(0.0))

    def train(self, featured: DataFrame, label: str = "label", trees: int = 20, depth: int = 3) -> ListwiseReranker:
        """featured: query_id, chunk_id, the features and a label, 0 where a candidate isn't relevant."""
        plain = featured.select("query_id", "chunk_id", F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("label"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in ranking.FEATURES))
        rows = with_ideal(plain.repartition("query_id"), "label", self.k).filter("ideal > 0").persist()
        self.trees, edges = [], self._edges(rows)
        for _ in range(trees):
            scored = lambdas(rows.withColumn("score", self.score()), k=self.k).persist()
            self.trees.append(self._grow(scored, edges, depth))
            scored.unpersist()
        rows.unpersist()
        return self

    def _edges(self, rows: DataFrame) -> dict[str, list[float]]:
        """Upper ends of each feature's bins: quantiles, but for the largest value."""
        shares = [i / self.bins for i in range(self.bins + 1)]
        found = rows.agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in ranking.FEATURES)).first()
        return {f: sorted(set(found[f] or []))[:-1] for f in ranking.FEATURES}

    def _grow(self, scored: DataFrame, edges: dict[str, list[float]], depth: int) -> Split | float:
        bins = {f: sum((F.when(F.col(f) > e, 1).otherwise(0) for e in ends), F.lit(0)) for f, ends in edges.items() if ends}
        if not bins:
            return 0.0
        splits: dict[int, tuple[str, float]] = {}  # a node's number: 1 is the root, 2n and 2n + 1 are below n
        values: dict[int, float] = {}
        layer = [1]
        for level in range(depth + 1):
            sums = self._sums(scored, bins, splits, layer)
            below = []
            for node in layer:
                found = sums.get(node)
                if found is None:
                    continue
                gradient, curvature, _ = next(iter(found.values())).sum(axis=0)
                values[node] = self.learning_rate * gradient / (curvature + self.smoothing)
                best = self._best(found, edges) if level < depth else None
                if best:
                    splits[node] = best
                    below += [2 * node, 2 * node + 1]
            layer = below
            if not layer:
                break

        def tree(node: int) -> Split | float:
            if node not in splits:
                return values.get(node, 0.0)
            return Split(*splits[node], tree(2 * node), tree(2 * node + 1))

        return tree(1)

    def _sums(self, scored: DataFrame, bins: dict[str, Column], splits: dict[int, tuple[str, float]], layer: list[int]) -> dict[int, dict[str, np.ndarray]]:
        """Of each node of the layer and each feature: gradient, curvature and rows by bin.  One aggregation; its rows
        are nodes times features times bins."""
        node = F.lit(1)
        for number in sorted(splits):  # parents before children
            feature, edge = splits[number]
            node = F.when(node == number, F.when(F.col(feature) <= F.lit(edge), 2 * number).otherwise(2 * number + 1)).otherwise(node)
        listed = F.array(*(F.struct(F.lit(f).alias("feature"), b.alias("bin")) for f, b in bins.items()))
        rows = scored.select(node.alias("node"), "gradient", "curvature", F.explode(listed).alias("x")).filter(F.col("node").isin(layer))
        summed = rows.groupBy("node", "x.feature", "x.bin").agg(F.sum("gradient").alias("g"), F.sum("curvature").alias("h"), F.count("*").alias("n"))
        out: dict[int, dict[str, np.ndarray]] = {}
        for r in summed.collect():
            out.setdefault(r.node, {f: np.zeros((self.bins + 1, 3)) for f in bins})[r.feature][r.bin] = (r.g, r.h, r.n)
        return out

    def _best(self, found: dict[str, np.ndarray], edges: dict[str, list[float]]) -> tuple[str, float] | None:
        """The split with the largest gain; of equal ones the first feature's lowest."""
        best, gain = None, 1e-9
        value = lambda s: s[0] ** 2 / (s[1] + self.smoothing)
        for feature, sums in found.items():
            whole, left = sums.sum(axis=0), np.zeros(3)
            for i, edge in enumerate(edges[feature]):
                left = left + sums[i]
                right = whole - left
                if min(left[2], right[2]) >= self.least_rows:
                    more = value(left) + value(right) - value(whole)
                    if more > gain + 1e-12:
                        best, gain = (feature, edge), more
        return best

    def rerank(self, featured: DataFrame, top_n: int) -> DataFrame:
        return ranking.rerank(featured, self.score(), top_n)
