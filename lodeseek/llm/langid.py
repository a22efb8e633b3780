"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.  Any other word backs off
to its character n-grams, the longest first: the first length of which the model knows some gram scores
it, with the mean over the known grams.  A document's score in a language is the mean over its words.
(The scheme of Jauhiainen et al., "HeLI, a Word-Based Backoff Method for Language Identification", 2016.)

The model is fitted on a sample of labelled rows whose size is a parameter: about ``rows_per_language``
rows of each label, chosen by a hash of the id, each with its whole text.  Counting is distributed; all labels,
words and grams of the sample are kept, so that the sample alone bounds the model, which goes to the executors.
It is sparse: of a word or gram it holds the languages that have it, and how far above an unseen one it is there.

A word is a letter and the letters and marks that follow it, in lower case, so that vowel signs don't cut words.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if there
is nothing to learn from.  Very long texts are scored whole, some ten thousand words at a time.  Equal scores go to
the label that sorts first.  Rows with a null id or label teach nothing but are predicted.  Repeated rows come back
as often as they came; repeated ids are in the sample together or not at all.  An empty table gives an empty result;
columns besides those named aren't looked at.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_LANGUAGE = 1000
LONGEST_GRAM = 5
SMOOTHING = 0.1
#: More words than this make a prediction no surer.
SURE_WORDS = 20
#: Scores of unseen words that a worker remembers.
MEMORY = 200_000
#: Words that are scored at once.
SLAB = 1 << 14
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = re.compile("[a-z]+")  # the same in texts that have nothing else


class Model(NamedTuple):
    """Item i has the languages columns[starts[i] : starts[i + 1]], and in gains the logarithm of how much more frequent
    it is there than an unseen one."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by length - 1
    starts: np.ndarray
    columns: np.ndarray
    gains: np.ndarray


def words_of(text: str | None) -> list[str]:
    lower = text.lower() if text else ""
    return (ASCII_WORD if lower.isascii() else WORD).findall(lower)


def grams_of(word: str, length: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + length] for i in range(len(padded) - length + 1)]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: words; kind n: n-grams of words."""
    for batch in batches:
        counts: Counter = Counter()
        by_language: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by_language.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in by_language.items():
            for word, n in words.items():
                counts[lang, 0, word] += n
                for length in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, length):
                        counts[lang, length, gram] += n
        langs, kinds, items = zip(*counts, strict=True) if counts else ((), (), ())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(items, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "kind", "item", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id"))
    labels = rows.groupBy("lang").count().collect()  # a row a label
    spread = 1 << 24
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(spread))
    share = {r.lang: min(1.0, rows_per_language / r["count"]) for r in labels}
    bounds = [F.lit(x) for lang, part in sorted(share.items()) for x in (lang, int(part * spread))]
    sample = rows.filter(place < F.create_map(*bounds)[F.col("lang")]) if bounds else rows.limit(0)
    counts = sample.select("lang", "text").mapInArrow(_count_batches, "lang string, kind int, item string, n long")
    table = counts.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    return _model(list(zip(table["lang"], table["kind"], table["item"], table["n"], strict=True)))


def _model(counts: list[tuple[str, int, str, int]]) -> Model:
    """counts: language, kind, item and how often."""
    counts = sorted(counts, key=lambda c: (c[1], c[2], c[0]))
    languages = sorted({c[0] for c in counts})
    number = {lang: i for i, lang in enumerate(languages)}
    places: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
    starts: list[int] = []
    for at, (_, kind, item, _) in enumerate(counts):
        if item not in places[kind]:
            places[kind][item] = len(starts)
            starts.append(at)
    columns = np.fromiter((number[c[0]] for c in counts), np.int32, len(counts))
    kinds = np.fromiter((c[1] for c in counts), np.int64, len(counts))
    tally = np.fromiter((c[3] for c in counts), np.float64, len(counts))
    totals = np.bincount(kinds * len(languages) + columns, tally, len(places) * len(languages)).reshape(len(places), -1)
    totals = totals + SMOOTHING * np.array([[max(1, len(known))] for known in places])
    unseen = np.log(SMOOTHING / totals.max(1, initial=SMOOTHING))  # alike for all languages: little data is no evidence
    gains = np.log((tally + SMOOTHING) / totals[kinds, columns]) - unseen[kinds]
    return Model(languages, places[0], places[1:], np.array([*starts, len(counts)], np.int64), columns, gains.astype(np.float32))


class Scorer(dict):
    """Word to its item; words that the model doesn't know become items of their own when met, many at once."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.items, self.entries = len(self.model.starts) - 1, len(self.model.columns)
        self.starts, self.columns, self.gains = self.model.starts, self.model.columns, self.model.gains

    def _room(self, name: str, used: int, more: int) -> None:
        own = getattr(self, name)
        if used + more > len(own):
            setattr(self, name, np.concatenate((own, np.zeros(max(1024, len(own) // 2, more), own.dtype))))

    def _learn(self, words: list[str]) -> None:
        """Makes items of words that the model doesn't know."""
        model, n = self.model, len(self.model.languages)
        left, found = words, []
        for length in range(LONGEST_GRAM, 0, -1):
            known, at, owners, rest = model.grams[length - 1], [], [], []
            for word in left:
                have = [known[g] for g in grams_of(word, length) if g in known]
                if have:
                    at += have
                    owners.append((word, len(have)))
                else:
                    rest.append(word)
            if owners:
                grams = np.array(at, np.int64)
                counts = np.array([c for _, c in owners], np.int64)
                entries, sizes = self._entries(model.starts, grams)
                place = np.repeat(np.repeat(np.arange(len(owners)), counts), sizes) * n + model.columns[entries]
                present, inverse = np.unique(place, return_inverse=True)
                gains = np.bincount(inverse, model.gains[entries]) / counts[present // n]
                found.append(([w for w, _ in owners], np.bincount(present // n, minlength=len(owners)), present % n, gains))
            left = rest
        found.append((left, np.zeros(len(left), np.int64), np.zeros(0, np.int64), np.zeros(0)))
        for new, sizes, columns, gains in found:
            for name, values in (("columns", columns), ("gains", gains)):
                self._room(name, self.entries, len(values))
                getattr(self, name)[self.entries : self.entries + len(values)] = values
            self._room("starts", self.items + 1, len(new))
            self.starts[self.items + 1 : self.items + 1 + len(new)] = self.entries + np.cumsum(sizes)
            self.update(zip(new, range(self.items, self.items + len(new)), strict=True))
            self.entries += len(columns)
            self.items += len(new)

    @staticmethod
    def _entries(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of the items at, one after the other, and how many each has."""
        first = starts[at]
        sizes = starts[at + 1] - first
        ends = np.cumsum(sizes)
        return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes

    def _sums(self, parts: list[list[str]]) -> np.ndarray:
        """Of each part's words the sums of gains by language."""
        if self.items > len(self.model.starts) + MEMORY:
            self._forget()
        words = list(itertools.chain.from_iterable(parts))
        if missing := [w for w in dict.fromkeys(words) if w not in self]:
            self._learn(missing)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        entries, sizes = self._entries(self.starts, at)
        n = len(self.model.languages)
        owner = np.repeat(np.repeat(np.arange(len(parts)), [len(p) for p in parts]), sizes)
        return np.bincount(owner * n + self.columns[entries], self.gains[entries], len(parts) * n).reshape(-1, n)

    def predict_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text.  Words are scored SLAB at a time, of several texts or of a part of one."""
        languages, texts = self.model.languages, list(texts)
        sums, counts = np.zeros((len(texts), len(languages))), np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, list[str]]] = []
        held = 0

        def score() -> None:
            if waiting and languages:
                np.add.at(sums, [i for i, _ in waiting], self._sums([p for _, p in waiting]))
            waiting.clear()

        for i, text in enumerate(texts):
            words = words_of(text)
            counts[i] = len(words)
            for slab in range(0, len(words), SLAB):
                part = words[slab : slab + SLAB]
                if held + len(part) > SLAB:
                    score()
                    held = 0
                waiting.append((i, part))
                held += len(part)
        score()
        if not languages:
            return [("und", 0.0)] * len(texts)
        means = sums / np.maximum(counts, 1)[:, None]
        best = means.argmax(axis=1)
        odds = np.exp((means - means.max(axis=1, keepdims=True)) * np.minimum(counts, SURE_WORDS)[:, None])
        scores = 1 / odds.sum(axis=1)
        return [(languages[b], s) if c else ("und", 0.0) for b, s, c in zip(best.tolist(), scores.tolist(), counts.tolist(), strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def _predict_batches(model: Broadcast, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            found = scorer.predict_all(x.as_py() for x in batch[text_col])
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *new], [*columns, "_lang_pred", "_score"])

    return run


def predict(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs with _lang_pred and _score (0 to 1)."""
    rows = docs.select(*dict.fromkeys([*columns, text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    run = _predict_batches(docs.sparkSession.sparkContext.broadcast(model), text_col, columns)
    return rows.mapInArrow(run, f"{schema}, _lang_pred string, _score double")


def identified(docs: DataFrame, model: Model, least_score: float) -> DataFrame:
    """The documents with a language of at least that score, with their own columns."""
    plain = {c: "text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)}  # no name can clash
    found = predict(docs.toDF(*plain.values()), model, list(plain.values()))
    kept = found.filter((F.col("_lang_pred") != "und") & (F.col("_score") >= least_score))
    return kept.select(*(F.col(new).alias(old) for old, new in plain.items()))
