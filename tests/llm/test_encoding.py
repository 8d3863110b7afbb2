"""Byte-level BPE against the public library, packing against the public tokenizer."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from aerolake.llm import bpe, packing

from . import support


@pytest.fixture(scope="module")
def encoding():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("which", ["tables", "awkward"])
def test_bpe_is_the_librarys(spark, sf_dir, encoding, which):
    docs = support.documents(spark, sf_dir) if which == "tables" else support.table(spark, support.awkward())
    expected = []
    for doc_id, text in support.pairs(docs):
        ids = encoding.encode_ordinary(text)
        assert encoding.decode_bytes(ids) == text.encode()
        shown = ",".join(map(str, ids))
        expected.append((doc_id, len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    found = support.rows(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == sorted(expected, key=str)


def test_bpe_of_nothing(spark):
    assert bpe.digests(support.empty(spark)).count() == 0


@pytest.mark.parametrize("which", ["tables", "awkward"])
def test_packing_keeps_every_id_once(spark, sf_dir, which):
    docs = support.documents(spark, sf_dir) if which == "tables" else support.table(spark, support.awkward())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    wanted = defaultdict(list)
    for doc_id, text in support.pairs(docs):
        wanted[doc_id].append(np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], np.uint32))
    pieces = [r.asDict() for r in packing.pack(docs).collect()]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(wanted)
    for doc_id, texts in wanted.items():
        expected = sorted((len(ids), p["start"], p["length"], zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())) for ids in texts for p in _cover(by_doc[doc_id], ids))
        assert sorted((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[doc_id]) == expected
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    total = sum(p["length"] for p in pieces)
    assert len(by_sequence) <= total / packing.CAPACITY * 1.05 + 2


def _cover(pieces, ids):
    """The pieces that a text of so many ids has to have: one for each start, gapless."""
    starts, at = {p["start"]: p for p in pieces if p["doc_tokens"] == len(ids)}, 0
    out = []
    while at < len(ids):
        out.append(starts[at])
        at += starts[at]["length"]
    return out


def test_lengths_waste_little():
    for n in range(0, 20_000, 7):
        cut = list(packing.lengths(n))
        assert sum(length for _, length in cut) == n
        assert all(length == packing.CAPACITY // k for k, length in cut)


def test_packing_of_nothing(spark):
    assert packing.pack(support.empty(spark)).count() == 0


def test_bpe_of_long_words(spark):
    """Words that are cut, contracted many pairs a step or by several queries, and very long ones, are the library's."""
    import base64
    import random

    import public_tokenizers
    import tiktoken
    from aerolake.llm import bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(path, public_tokenizers.PATTERN)
    rng = random.Random(3)
    words = ["".join(rng.choices(letters, k=n)) for letters in ("ab", "aaab", "etaoinshr", "abcdefghij", "éàü", "你好世界") for n in (65, 66, 100, 300, 1200)]
    words += ["a" * n for n in (64, 65, 127, 4097)] + ["ab" * 1000, "aab" * 700]
    for limit in (bpe._ROWS_AT_ONCE, 5000):
        bpe._ROWS_AT_ONCE, before = limit, bpe._ROWS_AT_ONCE
        try:
            for word, (ids, text) in zip(words, encoder._words([w.encode() for w in words])):
                assert ids == ",".join(map(str, library._encode_single_piece(word))) and text == word.encode()
        finally:
            bpe._ROWS_AT_ONCE = before
