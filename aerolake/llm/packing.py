"""Harmonic packing of token ids into sequences of fixed capacity.

Class k holds pieces of exactly floor(capacity / k) ids and each of its bins takes k of them, so a
bin's place follows from a piece's rank in its class alone and workers fill bins independently. A
document gives full-capacity pieces first; what remains is cut, largest first, into the reciprocal
lengths of the classes, which for a remainder r is at most a handful of cuts as each leaves at
most r * r / capacity. Only each class's last bin can be short: those few pieces (fewer than the
sum of k over the classes, a constant of the capacity) share sequences by first fit decreasing.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common
from .cache import Generations

CAPACITY = 2048
END_ID = 1
#: Characters that Python takes for white space and the tokenizer does not.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Begins each of the vocabulary's added tokens, in any case of its letters.
_ADDED = "<|"
#: The vocabulary's own split of lower-cased ASCII without white space.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLOCK = 1 << 20


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself where it prints, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_LETTERS = _byte_letters()


def _lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is like any other."""
    return "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes, as the tokenizer gives them.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its
    white-space-separated chunks in order; chunks and words are remembered, in bounded memory.
    A text that may hold an added token goes to the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.chunks = Generations(self._chunks, 200_000, batched=True)
        self.words = Generations(self._word, 150_000)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        split = [_ASCII.findall(c.lower()) if c.isascii() else _ANY.findall(_lower(unicodedata.normalize("NFC", c))) for c in chunks]
        self.words.learn(w for words in split for w in words)
        known = self.words.young
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, text: str) -> bytes:
        if _ADDED in text or any(c in text for c in _SEPARATORS):
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        out, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= _BLOCK else text.find(" ", at + _BLOCK)
            end = len(text) if end < 0 else end
            out += self.chunks.many(text[at:end].split())
            at = end
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Encoder(path)


def lengths(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(class, length) of the pieces that a document of n ids is cut into, in order."""
    for _ in range(n // capacity):
        yield 1, capacity
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity // k != rest:
            k += 1
        yield k, capacity // k
        rest -= capacity // k


_PIECE = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, slot long"


def _piece_batches(vocabulary: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, used = _encoder(vocabulary), TaskContext.get().partitionId(), {}
        names = [field.split()[0] for field in _PIECE.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64()}[field.split()[1]] for field in _PIECE.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = memoryview(encoder.encode(text.as_py()) + END_ID.to_bytes(4, "little"))
                total, start = len(ids) // 4, 0
                for k, length in lengths(total, capacity):
                    slot = used[k] = used.get(k, -1) + 1
                    out.append((part, doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, k, slot))
                    start += length
                if len(out) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return pieces


def _leftovers(totals: dict[int, int], first: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(class, rank, sequence, offset) of the pieces beyond each class's last full bin."""
    rest = [(capacity // k, k, rank) for k, total in totals.items() for rank in range(total - total % k, total)]
    filled: list[int] = []
    out = []
    for length, k, rank in sorted(rest, key=lambda x: (-x[0], x[1], x[2])):
        at = next((i for i, used in enumerate(filled) if used + length <= capacity), len(filled))
        if at == len(filled):
            filled.append(0)
        out.append((k, rank, first + at, filled[at]))
        filled[at] += length
    return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in exactly one piece; a null or empty text has the end id alone.
    Rows that repeat, or share or lack a doc_id, are packed each by itself. What reaches the driver
    is one total per class (at most 2 * sqrt(capacity) rows).
    """
    spark = common.ready(docs.sparkSession)
    pieces = common.persist(common.texts(docs).mapInArrow(_piece_batches(vocabulary, capacity), _PIECE), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("class", "part", F.coalesce(before, F.lit(0)).alias("base"))
    totals = {row[0]: row[1] for row in counts.groupBy("class").agg(F.sum("n")).collect()}
    first, starts = 0, []
    for k in sorted(totals):
        starts.append((k, first, totals[k] - totals[k] % k))
        first += totals[k] // k
    schema = T.StructType([T.StructField("class", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("full", T.LongType())])
    classes = spark.createDataFrame(starts, schema)
    tail = spark.createDataFrame(_leftovers(totals, first, capacity), "class int, rank long, seq long, at long")
    ranked = pieces.join(bases, ["class", "part"]).withColumn("rank", F.col("base") + F.col("slot")).drop("base", "slot", "part")
    # both lists are bounded by the capacity alone, whatever the input
    placed = ranked.join(F.broadcast(classes), "class").join(F.broadcast(tail), ["class", "rank"], "left")
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.coalesce("seq", F.col("first") + F.floor(F.col("rank") / F.col("class"))).alias("sequence_id"),
        F.coalesce("at", F.col("rank") % F.col("class") * F.col("length")).alias("offset"),
    )
