"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose measure is over a cutoff.  Cutoffs are chosen for each stratum (language) on
labelled documents, which a hash of the id parts in two: a quarter to design with, and a holdout to prove with.

Design.  For each stratum and rule, cutoffs are candidates at quantiles of the design part; the corners of the
upper hull of (good rejected, bad rejected) cut the way from no rejection to full rejection into steps, and the
steps of all rules are put in order of their gain, bad rejected for a good one.  Steps that gain less than ``balance``
are left out.  So there is one path of policies, each of which rejects all that the one before does, and more.

Proof.  Only the holdout is looked at.  "This policy rejects good documents at a rate over ``risk``" gets the exact
binomial p-value of the rejections among the good ones, which is below a level just if the Clopper-Pearson bound at
that level is below the rate.  Policies are tested in their order until the first that is not proved (a fixed
sequence, which costs no level), and the last one proved acts.  The strata share ``level`` evenly, and one that has
proved its whole path passes its share on to those that have not (a sequentially rejective procedure; Bretz and
others, "A graphical approach to sequentially rejective multiple test procedures", 2009).  So the chance that any
stratum's policy rejects over ``risk`` of its good documents is at most ``level``.  "Good documents" are here those
that the base rules keep: what these reject isn't counted.

Strata with so few good labels in the holdout that nothing could be proved for them alone are taken together: they
share one path, one test and one guarantee, that of the documents of all these strata together.  Which strata these
are is settled by the numbers of good labels alone.  If the rest is too small as well, base rules alone act there.

Defined results: a null or empty text has no words and fails the base rules, very long texts are counted whole; of
several labels of a document the worst counts; a null language is a stratum of its own; ties lie on one side of a
cutoff together; without labels only the base rules act; repeated rows come back as often as they came, and repeated
labelled documents count once; an empty table gives an empty result; columns besides those named aren't looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.shared import stash

RISK = 0.02
LEVEL = 0.05
#: A step of a path has to reject so many bad documents for each good one.
BALANCE = 2.0
CANDIDATES = 24
#: One of so many labelled documents is for the design.
DESIGN_PART = 4
#: The stratum of all documents whose own has too few labels.
REST = "*"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8 that don't begin a character.
CONTINUATION = bytes(range(128, 192))
MEASURES = ("symbols_per_word", "repeated_share", "double_line_share", "capital_share", "mark_share", "word_length", "word_shortness")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marked")


def counts_of(raw: bytes | None) -> tuple[int, ...]:
    """The COUNTS of UTF-8 text.  Words are split at ASCII white space; lines count if they have a word;
    marked words end with an exclamation mark."""
    words = raw.split() if raw else []
    if not words:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split()]
    capitals = len(joined) - len(joined.translate(None, CAPITALS))
    return (len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), capitals, sum(w.endswith(b"!") for w in words))


def repeated_words(words: list[bytes]) -> int:
    """Words in any three-word window that is found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(windows) == len(set(windows)):
        return 0
    times, covered, reach = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, reach)
            reach = at + 3
    return covered


def _count_batches(columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(x.as_py()) for x in batch[text_col]]
            new = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *new], [*columns, *COUNTS])

    return run


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, COUNTS, MEASURES and base_failed of every document."""
    own = F.col("lang") if stratum is None else stratum
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(own.cast("string"), F.lit("")).alias("stratum"), F.col(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count_batches(["doc_id", "stratum"], "text"), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    words, share = F.greatest(F.col("n_words"), F.lit(1)), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measures = {
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "double_line_share": share("n_dup_lines", "n_lines"),
        "capital_share": share("n_capitals", "word_chars"),
        "mark_share": share("n_marked", "n_words"),
        "word_length": F.col("word_chars") / words,
        "word_shortness": -F.col("word_chars") / words,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns(measures).withColumn("base_failed", failed)


def binomial_tail(rejected: int, good: int, rate: float) -> float:
    """P(X <= rejected) for X binomial of good trials with that rate: small if the rate must be lower."""
    if rejected >= good * rate:
        return 1.0
    log_n = math.lgamma(good + 1)
    log_p, log_q = math.log(rate), math.log1p(-rate)
    terms = [log_n - math.lgamma(k + 1) - math.lgamma(good - k + 1) + k * log_p + (good - k) * log_q for k in range(rejected + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def least_good(rate: float, level: float) -> int:
    """The number of good labels from which on a policy that rejects none of them is proved at that level."""
    return max(1, math.ceil(math.log(level) / math.log1p(-rate) - 1e-9))


Step = tuple[str, float]  # a measure and its new cutoff


def hull_steps(tallies: list[tuple[float, int, int]], balance: float) -> list[tuple[float, float]]:
    """tallies: cutoff, good and bad documents over it, by falling cutoff.  The corners of the upper hull as (gain of the
    way to it, cutoff), as far as the gain is at least balance."""
    corners: list[tuple[float, int, int]] = [(math.inf, 0, 0)]
    for cutoff, good, bad in tallies:
        if bad <= corners[-1][2]:
            continue  # as many bad for no fewer good
        while len(corners) > 1:
            (_, g0, b0), (_, g1, b1) = corners[-2:]
            if (bad - b1) * (g1 - g0) < (b1 - b0) * (good - g1):
                break
            corners.pop()
        corners.append((cutoff, good, bad))
    steps = []
    for (_, g0, b0), (cutoff, g1, b1) in zip(corners, corners[1:], strict=False):
        gain = (b1 - b0) / (g1 - g0) if g1 > g0 else math.inf
        if gain < balance:
            break
        steps.append((gain, cutoff))
    return steps


def path(tallies: dict[str, list[tuple[float, int, int]]], balance: float) -> list[Step]:
    """The steps of all measures, those of the largest gain first, in the order of MEASURES where gains are equal."""
    steps = [(-gain, at, number, measure, cutoff) for at, measure in enumerate(MEASURES) for number, (gain, cutoff) in enumerate(hull_steps(tallies.get(measure, []), balance))]
    return [(measure, cutoff) for _, _, _, measure, cutoff in sorted(steps)]


def proved(rejections: dict[str, tuple[int, list[int]]], risk: float, level: float) -> dict[str, int]:
    """rejections: for each stratum its good documents, and how many of them each policy of the path rejects.  How many
    policies are proved, from the first on."""
    share = {s: level / len(rejections) for s in rejections}
    done = dict.fromkeys(rejections, 0)
    while True:
        before = dict(done)
        for s, (good, counts) in sorted(rejections.items()):
            while done[s] < len(counts) and binomial_tail(counts[done[s]], good, risk) <= share[s]:
                done[s] += 1
        ended = [s for s in share if done[s] == len(rejections[s][1])]
        left = [s for s in share if s not in ended]
        if not left or (not ended and done == before):
            return done
        for s in left:
            share[s] += sum(share[e] for e in ended) / len(left)
        for s in ended:
            del share[s]
        rejections = {s: rejections[s] for s in left}


def design_part(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_, F.lit("design")), F.lit(DESIGN_PART)) == 0


def choose_cutoffs(features: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, balance: float = BALANCE) -> dict[tuple[str, str], float]:
    """(stratum, measure) to cutoff, infinite where a rule doesn't act; the stratum REST stands for all that aren't named.
    features: as measured() gives; labels: doc_id and quality (1: good)."""
    graded = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    wanted = features.filter(~F.col("base_failed")).select("doc_id", "stratum", *MEASURES)
    joined = wanted.join(graded, "doc_id").select("doc_id", "stratum", (F.col("quality") > 0).alias("good"), design_part(F.col("doc_id")).alias("design"), *MEASURES)
    labelled = stash(joined.distinct(), "labelled")
    sizes = labelled.filter("good and not design").groupBy("stratum").count().filter(F.col("count") >= least_good(risk, level)).collect()  # a row for so many labels
    own = sorted(r.stratum for r in sizes if r["count"] >= least_good(risk, level / (len(sizes) + 1)))
    named = F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(REST) if own else F.lit(REST)
    rows = stash(labelled.withColumn("stratum", named), "strata")
    paths = _design(rows.filter("design"), balance)
    counts = _rejections(rows.filter("not design and good"), paths)
    steps = proved({s: x for s, x in counts.items() if x[0] >= least_good(risk, level) and x[1]}, risk, level) if counts else {}
    found = {(s, m): math.inf for s in own for m in MEASURES}
    return found | {(s, m): cutoff for s, n in steps.items() for m, cutoff in paths[s][:n]}  # a later cutoff of a measure is lower


def _design(rows: DataFrame, balance: float) -> dict[str, list[Step]]:
    """The path of each stratum."""
    steps = F.array(*(F.lit(1 - 0.5 ** (1 + k / 2)) for k in range(CANDIDATES)))
    found = rows.groupBy("stratum").agg(*(F.array_distinct(F.percentile_approx(m, steps, 10_000)).alias(f"_{m}") for m in MEASURES))
    grids = {r.stratum: {m: sorted(r[f"_{m}"] or [], reverse=True) for m in MEASURES} for r in found.collect()}
    over = lambda m: F.size(F.filter(F.col(f"_{m}"), lambda c: F.col(m) > c))
    places = F.array(*map(over, MEASURES))  # quantiles rise, so their number says which the measure is over
    tallies = rows.join(F.broadcast(found), "stratum").select("stratum", "good", F.posexplode(places).alias("measure", "place")).groupBy("stratum", "measure", "place", "good").count().collect()
    table: dict[tuple, int] = {(r.stratum, r.measure, r.place, r.good): r["count"] for r in tallies}
    paths = {}
    for stratum, grid in grids.items():
        by_measure = {}
        for at, measure in enumerate(MEASURES):
            cutoffs, good, bad = grid[measure], 0, 0
            rows_ = []
            for place, cutoff in zip(range(len(cutoffs), 0, -1), cutoffs, strict=True):  # the largest cutoff has all places over it
                good += table.get((stratum, at, place, True), 0)
                bad += table.get((stratum, at, place, False), 0)
                rows_.append((cutoff, good, bad))
            by_measure[measure] = rows_
        paths[stratum] = path(by_measure, balance)
    return paths


def _rejections(good: DataFrame, paths: dict[str, list[Step]]) -> dict[str, tuple[int, list[int]]]:
    """For each stratum the number of rows and how many each policy rejects."""
    acting = {s: steps for s, steps in paths.items() if steps}
    listed = [(s, [(MEASURES.index(m), c, n) for n, (m, c) in enumerate(steps)]) for s, steps in sorted(acting.items())]
    table = good.sparkSession.createDataFrame(listed, "stratum string, steps array<struct<measure:int,cutoff:double,number:int>>")
    values = F.array(*MEASURES)
    over = F.filter("steps", lambda x: F.get(values, x["measure"]) > x["cutoff"])
    first = F.array_min(F.transform(over, lambda x: x["number"])).alias("step")
    found: dict[str, dict] = {}
    for r in good.join(F.broadcast(table), "stratum").groupBy("stratum", first).count().collect():
        found.setdefault(r.stratum, {})[r.step] = r["count"]
    out = {}
    for stratum, steps in acting.items():
        own = found.get(stratum, {})
        out[stratum] = (sum(own.values()), list(accumulate(own.get(n, 0) for n in range(len(steps)))))
    return out


def with_verdict(features: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """Adds rejected: whether a rule of the row's stratum rejects it.  There is a row of cutoffs for each stratum that
    has some hundred labels at least, and these rows go to all tasks."""
    of = lambda s: [cutoffs.get((s, m), math.inf) for m in MEASURES]
    rows = [(s, of(s)) for s in sorted({s for s, _ in cutoffs} - {REST})]
    table = features.sparkSession.createDataFrame(rows, "stratum string, cutoffs array<double>")
    rest = F.array(*map(F.lit, of(REST)))
    over = [F.col(m) > F.get(F.coalesce("cutoffs", rest), F.lit(at)) for at, m in enumerate(MEASURES)]
    return features.join(F.broadcast(table), "stratum", "left").withColumn("rejected", F.coalesce(reduce(Column.__or__, over), F.lit(False))).drop("cutoffs")


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """measured() with kept."""
    features = stash(measured(docs), "measures")
    cutoffs = choose_cutoffs(features, labels, **options)
    return with_verdict(features, cutoffs).withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("rejected")
