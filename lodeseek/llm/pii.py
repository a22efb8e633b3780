"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The field (Sarawagi and Cohen, "Semi-Markov Conditional Random Fields for Information Extraction", 2004)
scores whole candidate segments: how many digits, in which groups, with which separators, whether the
Luhn sum or the four octets hold, whether an address is spelled out, which cue stands before.  Dynamic
programming over entities of at most ``LONGEST`` tokens and ``LONGEST_CHARS`` characters chooses boundaries
and kinds jointly; a token outside entities scores 0.  An entity lies in one line, between characters that are
neither letters nor digits, and holds a digit, an at-sign or a spelled-out one, so texts are decoded around these.
Each token is in one stretch and in a bounded number of candidates: time is as the length, whatever the text.

The weights are fitted here by gradient ascent on the log-likelihood of sentences that ``examples`` makes
from a seed: kinds in many spellings, and numbers that are none of them (versions, dates, prices, keys).

Spans of the patterns always stay.  A decoded span is added if it overlaps none of them.

Defined results: null and empty texts have no spans; very long texts are searched whole, and memory is as of
their longest line; where two segmentations score alike, the one with the earlier start and without needless
entities wins; positions are code points; repeated rows come back as often as they came; an empty table gives an
empty result; columns besides those named aren't looked at, and their names can't clash with base and spans unless
they are asked for.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity, at most.
LONGEST = 22
#: Characters of an entity, at most: as many as an address may have.
LONGEST_CHARS = 254
#: Digits of an entity without an at-sign.
LEAST_DIGITS, MOST_DIGITS = 4, 24
#: Tokens looked at on either side of a stretch that can hold an entity.
CONTEXT = 4

# The patterns of the contract.  Possessive where giving back could not help.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Each at-sign is looked at once: what stands before it back to the last one or the last match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append(("email", start, tail.end()))
        free = tail.end() if tail else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping per kind; matches that fail their test are dropped without another try."""
    found = _emails(text)
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# The field.

TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
#: Every candidate holds one: a digit, an at-sign or a token of AT_WORDS in any case.
TRIGGER = re.compile(r"[0-9@]|(?<![^\W\d_])[Aa][Tt](?![^\W\d_])")
AT_WORDS = {"at"}
DOT_WORDS = {"dot"}
CUES = {
    "email": {"email", "mail", "write", "contact", "reach"},
    "ip": {"ip", "server", "host", "address", "node"},
    "card": {"card", "visa", "credit", "payment", "charge"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "ring"},
}


class Stretch:
    """Tokens of a part of a text, and the candidate segments in it."""

    def __init__(self, text: str, start: int = 0, stop: int | None = None) -> None:
        matches = list(TOKEN.finditer(text, start, len(text) if stop is None else stop))
        self.tokens = [m.group() for m in matches]
        self.lower = [x.lower() for x in self.tokens]
        self.letters = [x[0].isalpha() for x in self.tokens]
        self.starts = [m.start() for m in matches]
        self.ends = [m.end() for m in matches]
        self.before = text[start - 1] if start else " "
        after = self.ends[-1] if matches else start
        self.after = text[after] if after < len(text) else " "

    def candidates(self) -> Iterator[tuple[int, int, list[str]]]:
        """(first token, one past the last, features without the kind) of segments that can be an entity, by their start."""
        tokens, starts, ends = self.tokens, self.starts, self.ends
        n = len(tokens)
        for i, token in enumerate(tokens):
            if not (token[0].isalnum() or token in "+(") or (tokens[i - 1] if i else self.before)[-1].isalnum():
                continue
            digits = ats = 0
            cues = None
            limit = starts[i] + LONGEST_CHARS
            for j in range(i, min(n, i + LONGEST)):
                last = tokens[j]
                digits += len(last) if last[0] in "0123456789" else 0
                if last == "\n" or ats > 1 or ends[j] > limit or (digits > MOST_DIGITS and not ats):
                    break
                if (digits >= LEAST_DIGITS or ats) and (last[0].isalnum() or last == ")") and not (tokens[j + 1] if j + 1 < n else self.after)[0].isalnum():
                    cues = self._cues(i) if cues is None else cues
                    yield i, j + 1, self._features(i, j + 1) + cues
                ats += j > i and (last == "@" or self.lower[j] in AT_WORDS)

    def _cues(self, i: int) -> list[str]:
        """The kinds that one of the two words before token i tells of."""
        first = max(0, i - 2 * CONTEXT)
        near = [self.lower[x] for x in range(first, i) if self.letters[x] and len(self.tokens[x]) < 16][-2:]
        return [f"cue {kind}" for kind, cues in CUES.items() if not cues.isdisjoint(near)]

    def _features(self, i: int, j: int) -> list[str]:
        """Without the cues."""
        part = self.tokens[i:j]
        words = [self.lower[x] for x in range(i, j) if self.letters[x]]
        groups = [x for x in part if x[0] in "0123456789"]
        signs = {x for x in part if not x[0].isalnum()}
        digits = "".join(groups)
        left = self.tokens[i - 1] if i else self.before
        right = self.tokens[j] if j < len(self.tokens) else self.after
        out = ["bias"]
        if left in "@_%" or (left in "./-+" and part[0] != "+"):
            out.append("glued left")
        beyond = self.tokens[j + 1][0] if j + 1 < len(self.tokens) else " "
        if right in "@_%" or (right in ".-/," and beyond.isalnum()):
            out.append("glued right")
        if words:
            ats = part.count("@") + sum(map(words.count, AT_WORDS))
            dots = part.count(".") + sum(map(words.count, DOT_WORDS))
            out.append("one at" if ats == 1 else "no at" if not ats else "ats")
            out.append("dots" if dots else "no dot")
            if ats == 1:
                place = next(k for k, x in enumerate(self.lower[i:j]) if x == "@" or x in AT_WORDS)
                tail = [x for x in part[place + 1 :] if not x.isspace() and x not in "()[]"]
                head = [x for x in part[:place] if not x.isspace() and x not in "()[]"]
                spelled = "@" not in part
                if spelled and DOT_WORDS.isdisjoint(words) and not signs & {"(", "["}:
                    out.append("bare at")
                if tail and all((x[0].isalnum() and x.lower() not in DOT_WORDS) != bool(k % 2) for k, x in enumerate(tail)) and len(tail) % 2 and len(tail) > 1 and 2 <= len(tail[-1]) <= 6 and tail[-1].isalpha():
                    out.append("domain")
                if not spelled and any(x.isspace() for x in part):
                    out.append("gap in address")
                if len([x for x in head if x[0].isalnum()]) > 4 or (spelled and any(a[0].isalnum() and b[0].isalnum() for a, b in zip(head, head[1:], strict=False))):
                    out.append("long head")
        else:
            out.append("no letters")
            count = len(digits)
            out.append("digits " + ("under 9" if count < 9 else "9-11" if count < 12 else "12-15" if count < 16 else "16" if count == 16 else "17-19" if count < 20 else "over 19"))
            if 12 <= count <= 19 and luhn(digits):
                out.append("luhn")
            sizes = [len(g) for g in groups]
            if len(groups) == 1:
                out.append("one run")
            if len(groups) == 4 and all(_octet(g) for g in groups) and part.count(".") == 3 and not signs - {".", " "}:
                out.append("octets" if " " not in signs else "loose octets")
            if sizes[-2:] == [3, 4] or sizes[-3:] == [3, 3, 4]:
                out.append("3-4 groups")
            if len(sizes) >= 3 and all(s == 4 for s in sizes[:-1]) and sizes[-1] in (3, 4):
                out.append("4-4 groups")
            if sum(s == 1 for s in sizes) > 2 or len(sizes) > 6:
                out.append("scattered")
            if signs - {" ", "(", ")", "-", ".", "+"}:
                out.append("other signs")
            if part.count("(") != part.count(")"):
                out.append("open bracket")
            if "." in signs:
                out.append("points")
            out.append("plus" if part[0] == "+" else "bracket" if part[0] == "(" else "digit first")
            if "+" in part[1:]:
                out.append("plus inside")
            if part[-1] == ")":
                out.append("bracket last")
            if left == "(" or left == "+":
                out.append("sign left out")
        return out


def _score(weights: dict[tuple[str, str], float], kind: str, features: list[str]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in features)


#: Judged sets of features that a process remembers.
MOST_JUDGED = 100_000


class Judge:
    """The best kind of a candidate's features with its score.  Few sets of features occur, so each is added up once."""

    def __init__(self, weights: dict[tuple[str, str], float]) -> None:
        self.weights, self.known = weights, {}

    def __call__(self, features: list[str]) -> tuple[str, float]:
        key = tuple(features)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= MOST_JUDGED:
                self.known.clear()
            kind = max(KINDS, key=lambda k: _score(self.weights, k, features))
            found = self.known[key] = kind, _score(self.weights, kind, features)
        return found


def decode(stretch: Stretch, weights: dict[tuple[str, str], float] | Judge) -> list[tuple[str, int, int]]:
    """The best segmentation's entities: kind, first token, one past the last."""
    judge = weights if isinstance(weights, Judge) else Judge(weights)
    n = len(stretch.tokens)
    best: list[float] = [0.0] * (n + 1)
    back: list[tuple[int, str] | None] = [None] * (n + 1)
    done = 0

    def settle(until: int) -> None:
        """All candidates that end before are known, so tokens up to there can stay outside."""
        nonlocal done
        while done < until:
            if best[done] >= best[done + 1]:
                best[done + 1], back[done + 1] = best[done], None
            done += 1

    for i, j, features in stretch.candidates():
        settle(i)
        kind, gain = judge(features)
        score = best[i] + gain
        if score > best[i] and score > best[j]:
            best[j], back[j] = score, (i, kind)
    settle(n)
    found, j = [], n
    while j:
        if back[j]:
            found.append((back[j][1], back[j][0], j))
            j = back[j][0]
        else:
            j -= 1
    return found[::-1]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of lines, at token bounds, around what can be in an entity.  No character is in two of them."""
    span = 6 * LONGEST
    start = stop = 0
    for m in TRIGGER.finditer(text):
        low = max(0, m.start() - span, text.rfind("\n", stop, m.start()) + 1)
        while low > stop and text[low - 1].isalnum():
            low -= 1
        if low > stop:
            if stop > start:
                yield start, stop
            start = low
        high = min(len(text), m.end() + span)
        if high > stop:
            end = text.find("\n", m.end(), high)
            stop = high if end < 0 else end
            while stop < len(text) and text[stop].isalnum():
                stop += 1
    if stop > start:
        yield start, stop


def all_spans(text: str, weights: dict[tuple[str, str], float] | Judge) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the added ones."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    reach = list(accumulate((b for _, b in taken), max))
    added: list[Span] = []
    for start, stop in stretches(text):
        part = Stretch(text, start, stop)
        for kind, i, j in decode(part, weights):
            span = (kind, part.starts[i], part.ends[j - 1])
            before = bisect_left(taken, (span[2],))  # base spans that start before its end
            if not before or reach[before - 1] <= span[1]:
                added.append(span)
    return base, sorted({*base, *added}, key=_place)


# Fitting.


def examples(count: int = 500, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Made-up sentences with their entities."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "th", "on", "le", "is", "do", "me", "ra", "ti")) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        number = next(body + d for d in "0123456789" if luhn(body + d))
        return rng.choice(("", "", " ", "-", ".")).join(number[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = str(rng.randint(200, 999)), str(rng.randint(200, 999)), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {digits(7)}", f"+1 {a} {b} {c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}"))

    def ip() -> str:
        parts = [str(rng.randint(0, rng.choice((9, 255, 255)))) for _ in range(4)]
        return rng.choice((".", ".", ".", " . ")).join(parts)

    def email() -> str:
        name, host, top = word() + rng.choice(("", "." + word(), digits(2), "_" + word())), word() + rng.choice(("", digits(1))), rng.choice(("com", "org", "net", "de", "fr"))
        return rng.choice((f"{name}@{host}.{top}", f"{name}@{host}.{word()}.{top}", f"{word()} (at) {word()} (dot) {top}", f"{word()} [at] {word()} [dot] {top}", f"{word()} at {word()} dot {top}", f"{word()}(at){word()}.{top}"))

    def no_card() -> str:
        """Four groups of four whose Luhn sum fails."""
        number = next(n for n in iter(lambda: rng.choice("3456") + digits(15), "") if not luhn(n))
        return rng.choice((" ", "-", " ", ".")).join(number[k : k + 4] for k in range(0, 16, 4))

    def nothing() -> str:
        return rng.choice((
            f"{rng.randint(1, 9)}.{rng.randint(0, 20)}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 99)},{digits(3)},{digits(3)}.{digits(2)}", "AKIA" + digits(5) + "XYZ" + digits(6), "b7" + digits(7) + "fc" + digits(8), digits(rng.randint(7, 22)), " ".join(str(k) for k in range(1, rng.randint(9, 14))), f"{rng.randint(1, 20)}.{rng.randint(300, 999)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}", f"{word()} at {word()}.", f"page {digits(3)} of {digits(4)}", f"{digits(4)}:{digits(4)}:{digits(4)}", f"{word()}.com", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)} {digits(2)}:{digits(2)}:{digits(2)}", f"{digits(3)} {digits(3)} {digits(2)} {digits(1)} {digits(2)}",
            " ".join(str(rng.randint(1700, 2030)) for _ in range(rng.randint(3, 5))), no_card(), no_card(), f"{word()} at dot {word()}", f"{word()} at {word()} dot", f"{word()} at, dot {word()}",
            f"{rng.randint(1990, 2030)} {rng.randint(1990, 2030)} {rng.randint(1990, 2030)}", f"id={digits(8)}-{digits(4)}-{digits(4)}",
        ))

    made = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            kind = rng.choice((*KINDS, "none", "none", "none"))
            if kind != "none" and rng.random() < 0.3:
                text += rng.choice(sorted(CUES[kind])) + rng.choice((" ", ": "))
            entity = {"email": email, "ip": ip, "card": card, "phone": phone, "none": nothing}[kind]()
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(entity)))
            text += entity + rng.choice((" ", ". ", ", ")) + word() + " "
        made.append((text, spans))
    return made


@lru_cache(1)
def fitted_weights(rounds: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> dict[tuple[str, str], float]:
    """Maximum conditional likelihood by AdaGrad, over all segmentations of each example."""
    names: dict[tuple[str, str], int] = {}
    prepared = []
    for text, spans in examples():
        stretch = Stretch(text)
        rows, ends = [], []
        gold = {(kind, a, b) for kind, a, b in spans}
        met = []
        for i, j, features in stretch.candidates():
            for kind in KINDS:
                rows.append([names.setdefault((kind, f), len(names)) for f in features])
                ends.append((i, j))
                met.append((kind, stretch.starts[i], stretch.ends[j - 1]) in gold)
        if rows:
            prepared.append((len(stretch.tokens), rows, ends, np.array(met)))
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    flat = [(n, np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), ends, met) for n, rows, ends, met in prepared]
    for _ in range(rounds):
        gradient = -ridge * len(flat) * weights
        for n, features, owner, ends, met in flat:
            scores = np.bincount(owner, weights[features], len(met))
            marginals = np.array(_marginals(n, ends, scores.tolist()))
            gradient += np.bincount(features, (met - marginals)[owner], len(names))
        squares += gradient**2
        weights += rate * gradient / np.sqrt(squares)
    return {name: round(float(weights[at]), 6) for name, at in names.items()}


def _marginals(n: int, ends: list[tuple[int, int]], scores: list[float]) -> list[float]:
    """The probability of each segment under the field."""
    starting, ending = defaultdict(list), defaultdict(list)
    for (i, j), s in zip(ends, scores, strict=True):
        ending[j].append((i, s))
        starting[i].append((j, s))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, s in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = _log_sum([behind[i + 1], *(behind[j] + s for j, s in starting.get(i, ()))])
    return [math.exp(ahead[i] + s + behind[j] - ahead[n]) for (i, j), s in zip(ends, scores, strict=True)]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


# Over tables.

SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _batches(weights: dict[tuple[str, str], float], columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weights)
        for batch in batches:
            found = [all_spans(x.as_py() or "", judge) for x in batch[text_col]]
            new = [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in f[part]] for f in found], SPAN_TYPE) for part in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *new], [*columns, "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs with base and spans: arrays of kind, start and stop, in order."""
    rows = docs.select(*dict.fromkeys([*columns, text_col]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    kind = "array<struct<kind:string,start:long,stop:long>>"
    return rows.mapInArrow(_batches(fitted_weights(), columns, text_col), f"{schema}, base {kind}, spans {kind}")
