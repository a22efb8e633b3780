"""Scores of a batch of queries against rows of words, as products of matrices in the tasks, cut there to the k best.

A row with a common word meets nearly every query, so pairs are as many as rows times queries.  None of them leaves its
task or is kept in a hash table: a task holds the scores of some thousand rows and k results a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.dense import _best

#: Cells of a matrix of words and queries at most; a larger batch is cut by queries into several, which a task makes in turn.
MOST_CELLS = 16_000_000
#: Cells of a matrix of rows and words, and of rows and queries, at once.
SLICE_CELLS = 2_000_000
#: No score above 0 is less.
LEAST = 5e-10

#: chunk_ids, the number of the first query, and for each measure scores by query from there on and row.
Scores = Iterator[tuple[np.ndarray, int, dict[str, np.ndarray]]]
Scorer = Callable[[Iterator[pa.RecordBatch]], Scores]


class Part(NamedTuple):
    """Queries of a batch from number first on: weights has a row for each of their words, whose numbers ascend, and a column for each."""

    first: int
    numbers: np.ndarray
    weights: np.ndarray

    @property
    def slice_rows(self) -> int:
        return max(16, SLICE_CELLS // max(1, *self.weights.shape))

    def matrix(self, n: int, rows: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Of n rows and the part's words, the sums of values at rows and numbers of words; other words are left out."""
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        own = self.numbers[at] == numbers
        found = np.zeros((n, len(self.numbers)))
        np.add.at(found, (rows[own], at[own]), values[own])
        return found


class Batch(NamedTuple):
    """Queries and their words: of each pair the numbers of word and query, which ascend by query, and the weight.  cuts: first
    queries of the parts, and how many queries there are."""

    query_ids: pa.Array
    words: pa.Array
    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    cuts: list[int]

    def among(self, query_ids: pa.Array) -> Batch:
        """With its queries numbered as in query_ids, which has them all; without cuts."""
        columns = pc.index_in(self.query_ids, query_ids).to_numpy(zero_copy_only=False).astype(np.int64)[self.columns]
        order = np.argsort(columns, kind="stable")
        return Batch(query_ids, self.words, self.rows[order], columns[order], self.values[order], [])

    def part(self, first: int, last: int) -> Part:
        own = slice(*np.searchsorted(self.columns, [first, last]))
        numbers, at = np.unique(self.rows[own], return_inverse=True)
        weights = np.zeros((len(numbers), last - first))
        np.add.at(weights, (at, self.columns[own] - first), self.values[own])
        return Part(first, numbers, weights)

    def parts(self) -> Iterator[Part]:
        """One after the other, so that a task holds one matrix, and without those that have no word."""
        for first, last in zip(self.cuts, self.cuts[1:], strict=False):
            if len((part := self.part(first, last)).numbers):
                yield part


def cuts(rows: np.ndarray, columns: np.ndarray, n: int) -> list[int] | None:
    """First numbers of runs of the n queries, and n: words and queries of each run make MOST_CELLS cells at most.  None if a
    single query has more words."""
    found, words = [0], set()
    ends = np.searchsorted(columns, np.arange(n + 1))
    for query in range(n):
        own = set(rows[ends[query] : ends[query + 1]].tolist())
        if len(own) > MOST_CELLS:
            return None
        if len(words | own) * (query + 1 - found[-1]) > MOST_CELLS and query > found[-1]:
            found.append(query)
            words = set()
        words |= own
    return [*found, n]


def batch_of(weights: DataFrame) -> Batch | None:
    """weights: query_id, term, weight, which the caller has seen to be few.  None if a single query has too many words for a matrix."""
    rows = weights.filter("term is not null").select("query_id", "term", F.col("weight").cast("double")).toArrow().combine_chunks()
    queries, words = (pc.dictionary_encode(rows[c], null_encoding="encode").combine_chunks() for c in ("query_id", "term"))
    columns = queries.indices.to_numpy().astype(np.int64)
    order = np.argsort(columns, kind="stable")
    numbers, columns, values = words.indices.to_numpy().astype(np.int64)[order], columns[order], rows["weight"].to_numpy()[order]
    found = cuts(numbers, columns, len(queries.dictionary))
    return found and Batch(queries.dictionary, words.dictionary, numbers, columns, values, found)


def found_words(column: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the word and how often it stands there, for the words of each list that are among those."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(pc.index_in(column.flatten(), words, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column), dtype=np.int64), lengths)
    known = numbers >= 0
    keys, counts = np.unique(rows[known] * max(1, len(words)) + numbers[known], return_counts=True)
    return keys // max(1, len(words)), keys % max(1, len(words)), counts


def slices(n: int, step: int, rows: np.ndarray) -> Iterator[tuple[int, int, slice]]:
    """First row, one past the last, and where the entries of these are in rows, which ascend."""
    for start in range(0, n, step):
        stop = min(n, start + step)
        yield start, stop, slice(*np.searchsorted(rows, [start, stop]))


def each(score: Callable[[pa.RecordBatch], Scores]) -> Scorer:
    """For rows that are whole in themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Scores:
        for batch in batches:
            yield from score(batch)

    return run


def best_in_tasks(rows: DataFrame, scorer: Scorer, query_ids: pa.Array, kind: str, k: int) -> DataFrame:
    """scorer: of a task's batches, scores of rows by parts of the queries, 0 where there is none.  measure, query_id (of the type
    kind), chunk_id and score: each task's k best of each query, the smaller chunk_id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], tuple] = {}
        floors: dict[tuple[str, int], np.ndarray] = {}
        for ids, first, scores in scorer(batches):
            for measure, found in scores.items():
                key = (measure, first)
                if key not in kept:
                    kept[key] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                    floors[key] = np.full(len(found), LEAST)
                kept[key] = _best(kept[key], floors[key], found, ids, k)
        for (measure, first), (numbers, chunks, values) in kept.items():
            columns = [pa.array([measure] * len(chunks), pa.string()), query_ids.take(pa.array(first + numbers)), pa.array(chunks), pa.array(values)]
            yield pa.record_batch(columns, ["measure", "query_id", "chunk_id", "score"])

    return rows.mapInArrow(run, f"measure string, query_id {kind}, chunk_id long, score double")
