"""Secrets: fixed expressions find keys, and the guess cost of a value tells a credential from a word.

A value in a credential's context is cut into words, dates, repeats, keyboard walks and brute-force
spans so that an attacker who knows the pieces needs the fewest guesses; dynamic programming over
its positions finds that cut. Values that take LEAST_COST or more decimal digits of guesses are
secrets. The words and their ranks are counted over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The model's size: so many of the commonest words (at most 24 letters each) are sent to every task.
DICTIONARY = 20_000
#: A word of the model occurs so often at least; letters of random values then stay out of it.
LEAST_COUNT = 5
#: Decimal digits of guesses from which a value is a secret, and its least length.
LEAST_COST = 10.0
LEAST_LENGTH = 8

_SHORTEST, _LONGEST = 3, 24
_SHARES = 16
#: Decimal digits: of one brute-force character, of one more piece, and of the names that follow.
_BRUTE = 1.0
_PIECE = log10(2)
_DATE = log10(365 * 120)
_YEAR = log10(120)
_SIGN = log10(4)
_KEYS, _TURN = log10(47), log10(4.6)
#: Ends of a run tried beside its last one; longest part that a repeat is made of.
_ENDS, _PERIOD = 8, 4

# Rows of the keyboard and their indents in half keys, letters that digits and signs stand for, words that passwords are made of.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_INDENTS = (0, 3, 4, 5)
_SHIFTED = dict(zip('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./"))
_LEET = str.maketrans("4@8361!|05$7+2", "aabegiiiossttz")
COMMON = "password admin letmein welcome monkey dragon master login secret test example changeme default guest root user pass key token hello sunshine shadow".split()

_CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|pwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)"
    r"[\"'\]]{0,2}[\x20\t]*(?:=>|:=|[:=]|(?<=[\x20\t])is(?=[\x20\t]))[\x20\t]*[\"'`]?([^\x20\t-\r\"'`<>,;]+)",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_NAMED = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: A run of fewer characters fails, and so does what is left of it: only long enough runs need be sought.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DATES = (
    re.compile(r"(?:19|20)[0-9]{2}([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])", re.ASCII),
    re.compile(r"(?:0[1-9]|[12][0-9]|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)[0-9]{2}", re.ASCII),
    re.compile(r"(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12][0-9]|3[01])\1(?:19|20)[0-9]{2}", re.ASCII),
    re.compile(r"(?:19|20)[0-9]{2}()", re.ASCII),
)


def _places() -> dict[str, tuple[int, int]]:
    """Row of every key and where it begins, in halves of a key."""
    return {key: (row, 2 * n + indent) for row, (keys, indent) in enumerate(zip(_ROWS, _INDENTS)) for n, key in enumerate(keys)}


_PLACES = _places()


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The way from one key to another that touches it."""
    if a == b or a not in _PLACES or b not in _PLACES:
        return None
    down, right = (y - x for x, y in zip(_PLACES[a], _PLACES[b]))
    return (down, right) if abs(down) <= 1 and abs(right) <= (1 if down else 2) else None


def _case_cost(word: str) -> float:
    """Decimal digits of the ways to put a word's letters in capitals: none, the first or all are tried first."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return _PIECE
    letters = sum(c.isalpha() for c in word)
    return log10(sum(comb(letters, k) for k in range(1, min(upper, letters - upper) + 1)) + 1)


def _lower(value: str) -> str:
    """Lower case, a character for each character."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def _words(value: str, ranks: dict[str, int]) -> Callable[[int], Iterator[tuple[int, float]]]:
    """Words of the model from a position on: as they are, spelt with signs, or backwards."""
    low = _lower(value)
    plain = low.translate(_LEET)
    spelt = [0]
    for a, b in zip(low, plain):
        spelt.append(spelt[-1] + (a != b))

    def begin(at: int) -> Iterator[tuple[int, float]]:
        for end in range(at + _SHORTEST, min(len(value), at + _LONGEST) + 1):
            piece = low[at:end]
            costs = [log10(ranks[w]) + more for w, more in ((piece, 0.0), (piece[::-1], _PIECE)) if w in ranks]
            if signs := spelt[end] - spelt[at]:
                piece = plain[at:end]
                costs += [log10(ranks[w]) + more + signs * _PIECE for w, more in ((piece, 0.0), (piece[::-1], _PIECE)) if w in ranks]
            if costs:
                yield end, min(costs) + _case_cost(value[at:end])

    return begin


def _dates(value: str, at: int) -> Iterator[tuple[int, float]]:
    if not "0" <= value[at] <= "9":
        return
    for n, pattern in enumerate(_DATES):
        if found := pattern.match(value, at):
            yield found.end(), _YEAR if n == len(_DATES) - 1 else _DATE + _SIGN * bool(found[1])


def _runs(value: str, holds: Callable[[int], bool]) -> list[int]:
    """For each position the end of the longest run from it on whose every step k to k + 1 `holds`."""
    ends = [len(value)] * len(value)
    for k in range(len(value) - 2, -1, -1):
        ends[k] = ends[k + 1] if holds(k) else k + 1
    return ends


def _some(first: int, last: int, step: int = 1) -> Iterator[int]:
    """Ends of a run from the first possible one on, and the last."""
    yield from range(first, min(last, first + _ENDS * step) + 1, step)
    if last > first + _ENDS * step:
        yield last - (last - first) % step


def pieces(value: str, ranks: dict[str, int]) -> Callable[[int], Iterator[tuple[int, float]]]:
    """A function from a position to the (end, cost) of the named pieces that begin there."""
    keys = [_SHIFTED.get(c, c) for c in _lower(value)]
    steps = [_step(a, b) for a, b in zip(keys, keys[1:])]
    walks = _runs(value, lambda k: steps[k] is not None)
    rising = _runs(value, lambda k: ord(value[k + 1]) - ord(value[k]) == 1)
    falling = _runs(value, lambda k: ord(value[k]) - ord(value[k + 1]) == 1)
    same = {p: [0] * (len(value) + 1) for p in range(1, _PERIOD + 1)}
    for p, equal in same.items():
        for k in range(len(value) - p - 1, -1, -1):
            equal[k] = equal[k + 1] + 1 if value[k] == value[k + p] else 0
    turns = [0]  # changes of direction before each step
    for k in range(1, len(steps)):
        turns.append(turns[-1] + (steps[k] != steps[k - 1]))
    words = _words(value, ranks)

    def begin(at: int) -> Iterator[tuple[int, float]]:
        yield from words(at)
        yield from _dates(value, at)
        for p, equal in same.items():
            if equal[at] >= p and p + equal[at] >= _SHORTEST:
                for end in _some(at + 2 * p, at + p + equal[at] - equal[at] % p, p):
                    yield end, p * _BRUTE + log10((end - at) // p)
        for ends, start in ((rising, log10(26)), (falling, log10(26) + _PIECE)):
            if ends[at] - at >= _SHORTEST:
                for end in _some(at + _SHORTEST, ends[at]):
                    yield end, start + log10(end - at)
        if walks[at] - at > _SHORTEST:
            for end in _some(at + _SHORTEST + 1, walks[at]):
                yield end, _KEYS + log10(end - at) + _TURN * (1 + turns[end - 2] - turns[at])

    return begin


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """Decimal digits of the guesses that the cheapest cut of `value` takes.

    Every piece costs its own guesses and, but for the first, the choice of one more piece; a
    brute-force span costs its characters. The work grows with the value's length.
    """
    begin = pieces(value, ranks)
    never = float("inf")
    named, brute = [never] * (len(value) + 1), [never] * (len(value) + 1)
    named[0] = -_PIECE
    for at in range(len(value)):
        here = min(named[at], brute[at]) + _PIECE
        brute[at + 1] = min(brute[at + 1], brute[at] + _BRUTE, here + _BRUTE)
        for end, cost in begin(at):
            named[end] = min(named[end], here + cost)
    return max(0.0, min(named[-1], brute[-1]))


def _mixed(value: str) -> bool:
    """Whether a value has more than letters in the way of a word or a name."""
    return not value.isalpha() or not (value[1:].islower() or value.isupper())


def spans(text: str, cost: Callable[[str], float]) -> list[tuple[str, int, int, float | None, bool]]:
    """(kind, start, end, cost, base) by start, then kind; code points, end exclusive."""
    found: list[tuple[str, int, int, float | None, bool]] = []
    low = text.lower()
    named = any(name in low for name in _NAMED)
    if named:
        found += [("assign", *m.span(), None, True) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span(), None, True) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span(), None, True) for m in _HEX.finditer(text)]
    if named:
        taken = sorted(s[1:3] for s in found)
        reach = list(accumulate((end for _, end in taken), max))
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?)]}")
            start, end = m.start(1), m.start(1) + len(value)
            before = bisect_left(taken, (end, 0))  # base spans that begin before the value ends
            if len(value) < LEAST_LENGTH or not _mixed(value) or (before and reach[before - 1] > start):
                continue
            if (guesses := cost(value)) >= LEAST_COST:
                found.append(("credential", start, end, round(guesses, 2), False))
    order = ("assign", "access", "hex", "credential")
    return sorted(found, key=lambda s: (s[1], order.index(s[0]), s[2]))


def word_ranks(docs: DataFrame, size: int = DICTIONARY) -> dict[str, int]:
    """Ranks, from 1, of the `size` commonest words of all texts, after those of COMMON.

    Words are runs of 3 to 24 letters, lower-cased. Counts are summed in every task before they
    are shuffled, and the counted words dealt over _SHARES tasks: these send `size` words each to
    the driver, however many tasks counted.
    """
    words = common.texts(docs).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{_SHORTEST},}}"), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") <= _LONGEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)
    top = [row[0] for row in counted.repartition(_SHARES).orderBy(F.desc("n"), "word").limit(size).collect()]
    return {word: n for n, word in enumerate(dict.fromkeys([*COMMON, *top]), 1)}


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64()), ("base", pa.bool_())])
_NAMES = [_SPAN.field(i).name for i in range(_SPAN.num_fields)]


def find(docs: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """(doc_id, spans) of each row of `docs`, whole texts; spans by start, then kind.

    Kinds: assign, access and hex by their expressions, credential by guess cost. Null and empty
    texts have no spans. Repeated rows are judged each by itself. Base spans of different kinds may
    overlap; a credential lies beside all of them. Other columns of `docs` are left unread.
    """
    spark = common.ready(docs.sparkSession)
    ranks = spark.sparkContext.broadcast(word_ranks(docs, size))

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks.value

        @lru_cache(4096)
        def cost(value: str) -> float:
            return guess_cost(value, known)

        for batch in given:
            found = [[dict(zip(_NAMES, s)) for s in spans(t.as_py(), cost)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, cost: double, base: boolean>>"
    return common.texts(docs).mapInArrow(batches, schema)
