"""Chat formatting by columnar byte assembly.

A turn is written as `<turn>### Role:` newline, text, `</turn>` newline. Inside roles and texts a
backslash goes before every character that could begin a control string (and before backslashes),
so the output reads back to exactly what went in. Segment lengths, cumulative offsets and scatter
indices of a whole batch are computed as arrays and every byte is copied once into one
preallocated buffer, which becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, MIDDLE, CLOSE = b"<turn>### ", b":\n", b"</turn>\n"
#: A role's text counts for the loss.
LEARNED = "assistant"
_TEXT_ESCAPES, _ROLE_ESCAPES = b"\\<#", b"\\<#:"
_BLOCK = 4 << 20

_TURN = re.compile(rb"<turn>### ((?:[^\\:]|\\.)*+):\n((?:[^\\<]|\\.)*+)</turn>\n", re.S)
_ESCAPE = re.compile(rb"\\(.)", re.S)


def _special(raw: np.ndarray, characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table[raw]


def _scatter(out: np.ndarray, starts: np.ndarray, raw: np.ndarray, at: np.ndarray, special: np.ndarray, seen: np.ndarray) -> None:
    """Copy the rows of raw to their starts in out, with a backslash before each special byte."""
    shift = starts - at[:-1] - np.append(0, seen)[at[:-1]]
    place = np.arange(len(raw)) + seen + np.repeat(shift, np.diff(at))
    out[place] = raw
    out[place[special] - 1] = ord("\\")


def _constant(out: np.ndarray, starts: np.ndarray, text: bytes) -> None:
    out[starts[:, None] + np.arange(len(text))] = np.frombuffer(text, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns, and where each one's escaped text begins and ends in it (bytes)."""
    parts = []
    for column, characters in ((roles, _ROLE_ESCAPES), (texts, _TEXT_ESCAPES)):
        raw, at = common.utf8(column)
        special = _special(raw, characters)
        seen = np.cumsum(special)
        size = np.diff(at) + np.diff(np.append(0, seen)[at])
        parts.append((raw, at, special, seen, size))
    role_size, text_size = parts[0][4], parts[1][4]
    total = len(OPEN) + role_size + len(MIDDLE) + text_size + len(CLOSE)
    offsets = np.concatenate([[0], np.cumsum(total)])
    role_at = offsets[:-1] + len(OPEN)
    text_at = role_at + role_size + len(MIDDLE)
    out = np.empty(int(offsets[-1]), np.uint8)
    _constant(out, offsets[:-1], OPEN)
    _constant(out, role_at + role_size, MIDDLE)
    _constant(out, text_at + text_size, CLOSE)
    _scatter(out, role_at, *parts[0][:4])
    _scatter(out, text_at, *parts[1][:4])
    column = pa.Array.from_buffers(pa.string(), len(total), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return column, text_at - offsets[:-1], text_at - offsets[:-1] + text_size


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about _BLOCK text bytes, one row at least."""
    at = common.utf8(batch.column("text"))[1]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + _BLOCK, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


_FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _blocks(whole):
            formatted, start, end = assemble(batch.column("role"), batch.column("text"))
            learned = np.array([r == LEARNED for r in batch.column("role").to_pylist()], bool)
            columns = {
                "conv_id": batch.column("conv_id"),
                "turn": batch.column("turn"),
                "formatted": formatted,
                "loss_start": pa.array(start, pa.int64(), mask=~learned),
                "loss_end": pa.array(end, pa.int64(), mask=~learned),
            }
            yield pa.RecordBatch.from_pydict(columns)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end.

    A conversation's output is its turns' `formatted` strings by turn (null first), equal turns by
    the formatted string; the loss mask is the bytes from loss_start to loss_end of each, null for
    roles that are not learned. Null roles and texts count as empty; repeated rows are turns of
    their own. Formatting needs no shuffle: each row's bytes depend on that row alone.
    """
    common.ready(conversations.sparkSession)
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(_format_batches, _FORMATTED)


def read_back(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted output; raises where it isn't any."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at byte {at}")
        turns.append((_ESCAPE.sub(rb"\1", found[1]), _ESCAPE.sub(rb"\1", found[2])))
        at = found.end()
    return turns


class _Digest:
    """What is read back of one conversation; constant size whatever its length."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, start: int | None, end: int | None) -> None:
        for role, text in read_back(formatted):
            self.turns += 1
            self.text.update(role + b"\n" + text + b"\n")
        self.chars += len(formatted.decode())
        if start is not None:
            learned = _ESCAPE.sub(rb"\1", formatted[start:end])
            self.loss_chars += len(learned.decode())
            self.loss.update(learned)

    def row(self) -> tuple:
        return self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in _DIGESTS.split(", ")]
    current, digest, done = None, None, []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "loss_start", "loss_end"))
        for conv_id, start, end, view in zip(*columns, common.rows(batch.column("formatted"))):
            if digest is None or conv_id != current:
                if digest is not None:
                    done.append((current, *digest.row()))
                current, digest = conv_id, _Digest()
            digest.add(bytes(view), start, end)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip((current, *digest.row())), types)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from `format_turns` per conversation, in order of turns.

    A digest over a conversation is sequential, so its turns stream, sorted, through one task that
    holds one turn at a time.
    """
    n = common.partitions(formatted.sparkSession)
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(_digest_batches, _DIGESTS)
