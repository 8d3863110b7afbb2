"""Phrase collocations, mined level by level.

A phrase of k words is counted only where both phrases of k - 1 words in it are frequent. The
frequent phrases of a level go to every task as a bitmap of their hashes, whose size is fixed
however many they are: a hash that another phrase shares lets a rare phrase be counted, never
keeps a frequent one from it, and the counts themselves are by the phrases' own words. Tasks sum
up a block of text before anything is shuffled. Scores, cuts and containment then come from the
level tables alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MOST_WORDS = 4
#: Occurrences of a frequent phrase; percentage of a phrase's occurrences at which a longer one stands for it.
LEAST = 30
COVERED = 80
TOP = 2000
NO_LANG = "und"
#: Bits of the bitmap that is broadcast: 16 MB at any size of the corpus.
BITS = 1 << 27
#: Copies of a level's rows that the cuts of hot words are dealt over.
SALTS = 16

_BLOCK = 1 << 20
_BUCKET = 1 << 15  # bits in a row of Spark's bitmaps
_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(_BLANK)], _KINDS[list(_BREAK)] = 1, 2
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)


def blocks(raw: np.ndarray, at: np.ndarray, block: int = _BLOCK) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(words, row of each, piece of each) of the texts that begin at `at`, a block of bytes at a time.

    Pieces are numbered within all texts given. Blocks end between words.
    """
    begin, breaks, end = 0, 0, len(raw)
    while begin < end:
        stop = begin + block
        if stop < end:
            ahead = 1 << 12
            while True:  # on to the next byte that is of no word, or the next text
                gap = np.flatnonzero(_KINDS[raw[stop : stop + ahead]])
                row = at[np.searchsorted(at, stop)]
                stop_at = min(stop + int(gap[0]) if len(gap) else end, int(row))
                if len(gap) or stop_at <= stop + ahead:
                    stop = stop_at
                    break
                ahead *= 8
        stop = min(stop, end)
        part = raw[begin:stop]
        kinds = _KINDS[part]
        solid = kinds == 0
        first = at[np.searchsorted(at, begin) : np.searchsorted(at, stop)] - begin
        fresh = np.append(True, ~solid[:-1])
        fresh[first] = True
        last = np.append(~solid[1:], True)
        last[first[first > 0] - 1] = True
        starts, ends = np.flatnonzero(solid & fresh), np.flatnonzero(solid & last) + 1
        offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOW[part[solid]]))
        rows = np.searchsorted(at, starts + begin, "right") - 1
        marks = np.cumsum(kinds == 2, dtype=np.int64) + breaks
        yield words, rows, marks[starts]
        breaks = int(marks[-1]) if len(marks) else breaks
        begin = stop


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(words: np.ndarray, langs: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on, and of their lang; the last k - 1 places have none."""
    n = max(0, len(words) - k + 1)
    h = langs[:n].copy()
    for j in range(k):
        h = _mixed(h * _ODD + words[j : j + n])
    return h


def _apart(keys: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of each different row of the columns of numbers below `sizes`."""
    q = keys[0].astype(np.int64)
    for n, (key, size) in enumerate(zip(keys[1:], sizes[1:])):
        if n:  # few enough to multiply again
            q = np.unique(q, return_inverse=True)[1].reshape(-1)
        q = q * size + key
    _, index, counts = np.unique(q, return_index=True, return_counts=True)
    return index, counts


_COUNTED = "lang string, phrase string, n long"
_NAMES = ["lang", "phrase", "n"]


class Miner:
    """Counts the phrases of k words in batches; `bits`, for k over 1, tells the frequent phrases of k - 1."""

    def __init__(self, k: int, bits: np.ndarray | None, block: int = _BLOCK):
        self.k, self.bits, self.block = k, bits, block

    def _frequent(self, h: np.ndarray) -> np.ndarray:
        bit = (h % np.uint64(8 * len(self.bits))).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)

    def _block(self, words: pa.Array, langs: np.ndarray, rows: np.ndarray, marks: np.ndarray, names: pa.Array, carried: int) -> pa.RecordBatch:
        k, n = self.k, len(words)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        own, speech = _hashes(coded.dictionary)[codes], _hashes(names)[langs]
        on = (rows[1:] == rows[:-1]) & (marks[1:] == marks[:-1])  # the next word is of the same piece
        whole = np.ones(max(0, n - k + 1), bool)
        for j in range(k - 1):
            whole &= on[j : j + len(whole)]
        whole[: max(0, carried - k + 1)] = False  # counted with the block before
        if k > 1:
            known = np.zeros(n - k + 2 if n > k - 2 else 0, bool)
            asked = np.flatnonzero(np.append(whole, False) | np.append(False, whole))
            known[asked] = self._frequent(_gram_hashes(own, speech, k - 1)[asked])
            whole &= known[:-1] & known[1:]
        at = np.flatnonzero(whole)
        index, counts = _apart([langs[at], *[codes[at + j] for j in range(k)]], [len(names), *[len(coded.dictionary)] * k])
        at = at[index]
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(at + j)) for j in range(k)], " ") if k > 1 else words.take(pa.array(at))
        return pa.RecordBatch.from_arrays([names.take(pa.array(langs[at])), phrase, pa.array(counts.astype(np.int64))], _NAMES)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names, lang_of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            total = np.zeros(len(names), np.int64)
            kept = None
            for words, rows, marks in blocks(*common.utf8(batch.column("text")), self.block):
                total += np.bincount(lang_of[rows], minlength=len(names))
                carried = len(kept[0]) if kept else 0
                if carried:
                    words, rows, marks = pa.concat_arrays([kept[0], words]), np.append(kept[1], rows), np.append(kept[2], marks)
                tail = len(words) - min(self.k - 1, len(words))
                if len(words):
                    yield self._block(words, lang_of[rows], rows, marks, names, carried)
                kept = words[tail:], rows[tail:], marks[tail:]
            if self.k == 1:  # all words of each lang, as of a phrase of none
                none = pa.nulls(len(names), pa.string())
                yield pa.RecordBatch.from_arrays([names, none, pa.array(total)], _NAMES)


def _placed(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Place, from 1, of each phrase of k words in the bitmap."""
    for batch in batches:
        words = pc.list_flatten(pc.split_pattern(batch.column("phrase"), " "))
        own, speech = _hashes(words).reshape(-1, k), _hashes(batch.column("lang"))
        h = np.zeros(0, np.uint64) if not len(own) else _gram_hashes(own.reshape(-1), np.repeat(speech, k), k)[::k]
        yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(bits)).astype(np.int64) + 1)], ["p"])


def _bitmap(level: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bits of the hashes of a level's phrases: `bits` / 8 bytes, whatever the number of phrases."""
    placed = level.where("phrase is not null").select("lang", "phrase").mapInArrow(lambda batches: _placed(batches, k, bits), "p long")
    rows = placed.groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for bucket, bitmap in rows:
        start = (bucket - 1) * _BUCKET // 8
        out[start : start + _BUCKET // 8] = np.frombuffer(bitmap, np.uint8)[: len(out) - start]
    return out


def levels(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, bits: int = BITS) -> list[DataFrame]:
    """Tables (lang, phrase, f) of the frequent phrases of 1, 2, ... words, written to the shared folder.

    The first has a row for each lang with a null phrase: the number of all its words.
    """
    if bits < 8 or bits & (bits - 1):
        raise ValueError("bits must be a power of two of 8 or more")
    spark = common.ready(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found: list[DataFrame] = []
    for k in range(1, most_words + 1):
        known = spark.sparkContext.broadcast(_bitmap(found[-1], k - 1, bits)) if found else None

        def count(batches: Iterator[pa.RecordBatch], k: int = k, known=known) -> Iterator[pa.RecordBatch]:
            yield from Miner(k, known.value if known else None)(batches)

        summed = texts.mapInArrow(count, _COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found.append(common.persist(summed.where((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}"))
    return found


def _exact(column: Column | str | int) -> Column:
    return (F.lit(column) if isinstance(column, int) else F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def _best_cuts(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate's lowest-scoring cut; parts are read from the level tables."""
    cuts = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    parts = [F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt")
    cuts = cuts.select("lang", "phrase", "a", "cut", *parts, salt)
    dealt = grams.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = cuts.join(dealt.toDF("lang", "left", "l", "salt"), ["lang", "left", "salt"]).join(dealt.toDF("lang", "right", "r", "salt"), ["lang", "right", "salt"])
    score = F.expr("CAST(2000000 AS DECIMAL(20,0)) * CAST(a AS DECIMAL(18,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _longest(grams: DataFrame) -> DataFrame:
    """(lang, phrase, longest): occurrences of the most frequent longer candidate that holds a phrase of two words or more."""
    words = F.split("phrase", " ")
    size = grams.where("k > 2").select("lang", "f", "k", words.alias("words"), F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    part = size.select("lang", "f", "words", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start"))
    phrase = F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase")
    return part.select("lang", phrase, "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` phrases by score, then a, then phrase.

    A null lang counts as `und`, a null text as empty. Words are runs of characters other than
    space and tab, A-Z lower-cased; phrases don't cross a mark of punctuation, a line end or a
    text's end. Repeated rows count each. A lang without candidates has no rows. Other columns of
    `docs` are left unread. The level tables are gone when the result is written.
    """
    found = levels(docs, most_words, least, bits)
    sized = [t.where("phrase is not null").select("lang", "phrase", F.lit(k).alias("k"), "f") for k, t in enumerate(found, 1)]
    grams = sized[0]
    for more in sized[1:]:
        grams = grams.unionByName(more)
    candidates = grams.where("k > 1")
    scored = _best_cuts(candidates, grams).join(_longest(grams), ["lang", "phrase"], "left")
    covered = F.coalesce(_exact(100) * _exact("longest") >= _exact(COVERED) * _exact("a"), F.lit(False))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a lang's rows are first cut down in shares, as many as there are partitions
    share = F.pmod(F.xxhash64("phrase", F.lit(1)), F.lit(common.partitions(docs.sparkSession)))
    first = scored.where(~covered).withColumn("share", share)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    result = common.persist(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for table in found:
        common.discard(table)
    return result


def oracle() -> str:
    """The same rows in SQL, by lists of words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut = "array_to_string(ws[{}], ' ')"
    return f"""
        with d as (select coalesce(lang, '{NO_LANG}') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
        p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from d),
        t as (select lang, sum(len(ws))::bigint as n from p group by lang),
        o as (select lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) as phrase from p, range(1, {MOST_WORDS + 1}) as s(k)),
        g as (select lang, k, phrase, count(*) as f from o group by all having count(*) >= {LEAST}),
        c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from g where k > 1),
        x as (select c.*, j, {cut.format('1:j')} as lp, {cut.format('j + 1:k')} as rp from c, range(1, {MOST_WORDS}) as s(j) where j < k),
        y as (select x.lang, x.phrase, x.a, j, l.f as l, r.f as r, ((2000000::hugeint * x.a) // (l.f + r.f))::bigint as score
            from x join g l on l.lang = x.lang and l.phrase = lp join g r on r.lang = x.lang and r.phrase = rp),
        z as (select * from y qualify row_number() over (partition by lang, phrase order by score, j) = 1),
        b as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(a) as longest from c, range(2, {MOST_WORDS}) as s(m), range(1, {MOST_WORDS}) as u(i)
            where m < k and i + m - 1 <= k group by all)
        select z.lang, row_number() over (partition by z.lang order by score desc, a desc, z.phrase) as rank, z.phrase, a, l, r, n, score
        from z join t on t.lang = z.lang left join b on b.lang = z.lang and b.phrase = z.phrase
        where not coalesce(100 * longest::hugeint >= {COVERED} * a::hugeint, false)
        qualify rank <= {TOP}"""
