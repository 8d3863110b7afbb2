"""Phrase mining against plain counting, at small thresholds, bitmaps and blocks."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from aerolake.llm import collocations as c
from aerolake.llm import common
from pyspark.sql import functions as F

from . import support

UPPER = {i: i + 32 for i in range(65, 91)}


def counts(rows, most=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def plainly(rows, least, top):
    f, n = counts(rows)
    f = {g: a for g, a in f.items() if a >= least}
    longest = defaultdict(int)
    for (lang, words), a in f.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                longest[lang, words[i : i + k]] = max(longest[lang, words[i : i + k]], a)
    out = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) > 1 and 100 * longest[lang, words] < 80 * a:
            cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    rank = [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(rank)


def table(spark, rows):
    full = [(i, text, lang, "s", 1, 2, "x", 3, 4) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, rank string, n long, f int, phrase string, k int, share int")


def noise(seed, size):
    rng = random.Random(seed)
    words = [*"abcdefgh", "The", "the", "ÉÉ", "x y", "🎉", "don't"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(["  ", " ", " ", "\t", " ", ". ", "\n", ", "]) for _ in range(rng.randrange(60)))) for _ in range(size)]


@pytest.mark.parametrize("bits", [8, 1 << 20])
def test_against_plain_counting(spark, bits):
    rows = [*noise(1, 150), (None, None), ("en", ""), ("en", " .,; \n"), ("fr", "only once here"), ("en", "a b c d " * 400)]
    found = c.collocations(table(spark, rows), least=4, top=25, bits=bits)
    assert sorted(map(tuple, found.collect())) == plainly(rows, 4, 25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_blocks_lose_and_repeat_nothing(block):
    rows = [*noise(2, 40), ("en", "w" * 300 + " " + "v" * 20), ("en", ""), ("de", "z")]
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if lang is None else lang for lang, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    want, n = counts(rows)
    every = np.full(16, 255, np.uint8)
    for k in range(1, 5):
        got, total = Counter(), Counter()
        for out in c.Miner(k, every if k > 1 else None, block)([batch]):
            for lang, phrase, times in zip(*(out.column(x).to_pylist() for x in ("lang", "phrase", "n"))):
                if phrase is None:
                    total[lang] += times
                else:
                    got[lang, tuple(phrase.split(" "))] += times
        assert got == {g: a for g, a in want.items() if len(g[1]) == k}
        assert k > 1 or +total == +n


def test_bitmap_has_every_frequent_phrase_and_prunes(spark):
    rows = [("en", "a b c d e f g h") for _ in range(9)] + [("en", f"q{i} r{i} s{i}") for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in rows]), pa.array([t for _, t in rows])], ["lang", "text"])
    first = c.levels(table(spark, rows), most_words=1, least=9, bits=1 << 16)[0]
    bits = c._bitmap(first, 1, 1 << 16)
    assert int(np.unpackbits(bits).sum()) == 8
    emitted = {p for out in c.Miner(2, bits)([batch]) for p in out.column("phrase").to_pylist()}
    assert emitted == {"a b", "b c", "c d", "d e", "e f", "f g", "g h"}


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000
    level = [("x", "a", 1, 2 * big), ("x", "b", 1, 2 * big + 1), ("x", "a b", 2, big)]
    grams = spark.createDataFrame(level, "lang string, phrase string, k int, f long")
    row = c._best_cuts(grams.where("k > 1"), grams).first()
    assert (row.score, row.l, row.r) == (2000000 * big // (4 * big + 1), 2 * big, 2 * big + 1)


def test_level_tables_are_gone(spark):
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("aerolake-phrases-*"))
    c.collocations(table(spark, noise(3, 30)), least=3).count()
    assert folder.exists() and set(folder.glob("aerolake-phrases-*")) == before


def test_empty_and_no_langs(spark):
    assert c.collocations(table(spark, noise(1, 2)).where(F.lit(False))).collect() == []
    assert c.collocations(table(spark, [(None, None), ("en", "x")])).collect() == []
    with pytest.raises(ValueError):
        c.levels(support.empty(spark), bits=1000)
