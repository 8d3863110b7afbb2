"""Texts that hold the vocabulary's added tokens, against the tokenizer's default call."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from aerolake.llm import packing

from . import support


def test_added_tokens_are_the_default_calls(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert added and all(t.startswith(packing._ADDED) for t in added)
    texts = ["a <|endoftext|> b", "a<|startoftext|>b", "x <|EndOfText|>  <|endoftext|", "<| no token |>", "plain words"]
    expected = []
    for n, text in enumerate(texts + added):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], np.uint32)
        expected.append((n, len(ids), zlib.crc32(ids.tobytes())))
    docs = support.table(spark, list(enumerate(texts + added)))
    found = packing.pack(docs).where("length = doc_tokens")
    encoded = [(n, packing._encoder("word_bpe_49k.json").encode(t)) for n, t in enumerate(texts + added)]
    assert [(n, len(b) // 4 + 1, zlib.crc32(b + packing.END_ID.to_bytes(4, "little"))) for n, b in encoded] == expected
    assert {tuple(r) for r in found.select("doc_id", "doc_tokens", "ids_crc32").collect()} <= set(expected)
