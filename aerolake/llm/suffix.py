"""Exact repeats of long byte strings by run-length compressed suffix indexes.

Every window of LENGTH bytes is named by the least hash of its K-byte grams, its anchor; equal
windows have equal anchors, so only text whose anchor occurs twice is indexed, and an index needs
only the windows of its own anchors. Consecutive windows with one anchor form a segment; equal
segments are indexed once. A task sorts the suffixes of its segments' windows, keeps the run ends
of the Burrows-Wheeler transform with their longest common prefixes, and streams through the text:
between run ends the matching statistic of a position is that of the position before, less one.
Positions whose statistic reaches LENGTH begin a repeated window.

The segments of an anchor with more of them than GROUP are cut into pieces of windows at like
places relative to the anchor. Equal windows lie in pieces that agree on all bytes which the
windows of such a piece share, so these bytes name a smaller bin; equal pieces are indexed once.
Should a bin still have more than WIDE_GROUP pieces, it is dealt over several indexes; each of
them also gives every different window of its own once, by hash, and windows that two indexes gave
are repeated too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
K = 32
#: Segments of one anchor, or pieces of one bin, in one index; windows after which a task closes an index.
GROUP = 300
WIDE_GROUP = 2500
CHUNK = 30_000
#: Places relative to the anchor that the windows of a piece can have.
WIDTH = 32
#: Longest run of windows in a segment: longer ones, in periodic text, are cut.
LONGEST = 2048
_BLOCK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.cumprod(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_UP, _DOWN = _powers(_BASE, _BLOCK + LENGTH), _powers(_INVERSE, _BLOCK + LENGTH)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each position of at most _BLOCK + LENGTH bytes."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:])
    h = sums[K:] - sums[:-K]
    h *= _DOWN[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, from minima to and from block borders."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in the texts raw[begin:end]: (text, start, windows, anchor, alone).

    alone is False where the run holds its anchor's gram twice, so that it may repeat itself.
    """
    hashes = gram_hashes(raw)
    least = sliding_minimum(hashes, LENGTH - K + 1)
    change = np.zeros(len(raw) + 1, np.int32)
    last = end - LENGTH  # last window of each text
    fits = last >= begin
    begin, last, number = begin[fits], last[fits], np.flatnonzero(fits)
    np.add.at(change, begin, 1)
    np.add.at(change, last + 1, -1)
    valid = np.cumsum(change[:-1])[: len(least)] > 0
    new = np.append(True, least[1:] != least[:-1])
    new[begin] = True
    start = np.flatnonzero(valid & new)
    text = np.searchsorted(begin, start, "right") - 1
    after = np.append(start[1:], len(raw))
    stop = np.minimum(after - 1, last[text])  # last window of the run
    own = np.concatenate([[0], np.cumsum(hashes[: len(least)] == least)])
    alone = own[stop] == own[start]
    long = stop - start >= LONGEST
    if long.any():
        pieces = [np.arange(a, b + 1, LONGEST) for a, b in zip(start.tolist(), stop.tolist())]
        counts = np.array(list(map(len, pieces)))
        text, alone, whole_stop = (np.repeat(x, counts) for x in (text, alone & ~long, stop))
        start = np.concatenate(pieces)
        stop = np.minimum(start + LONGEST - 1, whole_stop)
    return number[text], start, stop - start + 1, least[start], alone


_RUN = "did long, th long, start long, n int, anchor long, alone boolean, digest binary"


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = common.utf8(batch.column("text"))
        did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
        row = 0
        while row < batch.num_rows:
            # texts up to _BLOCK bytes together, or one longer text in blocks that overlap
            end = max(row + 1, int(np.searchsorted(at, at[row] + _BLOCK, "right")) - 1)
            for a in range(int(at[row]), int(at[end]), _BLOCK):
                b = min(a + _BLOCK + LENGTH - 1, int(at[end]))
                if b - a < LENGTH:
                    continue
                block = raw[a:b]
                begin = np.maximum(at[row:end] - a, 0)
                stop = np.minimum(at[row + 1 : end + 1], b) - a
                text, start, n, anchor, alone = segments(block, begin, stop)
                if not len(start):
                    continue
                view = memoryview(block.tobytes())
                digests = [_digest(view[s : s + m + LENGTH - 1]) for s, m in zip(start.tolist(), n.tolist())]
                columns = {
                    "did": did[row + text],
                    "th": th[row + text],
                    "start": start + a - at[row + text],
                    "n": n.astype(np.int32),
                    "anchor": anchor.view(np.int64),
                    "alone": alone,
                    "digest": pa.array(digests, pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
            row = end


_SEGMENT = "anchor long, digest binary, base int, bin long, rel binary, dealt boolean, piece binary"


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _cut(anchor: int, segment: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first window, bin, bytes) of the pieces of a segment."""
    hashes = gram_hashes(np.frombuffer(segment, np.uint8))
    grams = np.flatnonzero(hashes.view(np.int64) == anchor)
    windows = np.arange(len(segment) - LENGTH + 1)
    gram = grams[np.searchsorted(grams, windows)]  # each window's first gram of the anchor
    place = (gram - windows) // WIDTH
    starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (place[1:] != place[:-1])))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(windows)]):
        near = int(place[a]) * WIDTH
        shared = segment[gram[a] - near : gram[a] - near - WIDTH + 1 + LENGTH]
        yield a, int.from_bytes(_digest(anchor.to_bytes(8, "little", signed=True), near.to_bytes(4, "little"), shared)[:8], "little", signed=True), segment[a : b + LENGTH - 1]


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments listed with each text, those of large anchors in pieces."""
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.binary())
    names = [f.split()[0] for f in _SEGMENT.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for view, wanted in zip(common.rows(batch.column("text")), batch.column("wanted").to_pylist()):
            for w in wanted:
                segment = bytes(view[w["start"] : w["start"] + w["n"] + LENGTH - 1])
                if w["dealt"]:
                    out += [(w["anchor"], w["digest"], base, bin_, _digest(piece), True, piece) for base, bin_, piece in _cut(w["anchor"], segment)]
                else:
                    out.append((w["anchor"], w["digest"], 0, w["anchor"], w["digest"], False, segment))
                size += len(segment)
            if size > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix where it reaches LENGTH, else 0."""
    if a[:LENGTH] != b[:LENGTH]:
        return 0
    low, high = LENGTH, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def matching_statistics(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Longest match of each window of the pieces with another position, where LENGTH or more.

    Returns the statistics in text order, the suffix order, and the suffixes in text order.
    """
    suffixes = [p[i:] for p in pieces for i in range(len(p) - LENGTH + 1)]
    n = len(suffixes)
    order = np.array(sorted(range(n), key=suffixes.__getitem__), np.int64)
    heads = np.cumsum([0, *(len(p) - LENGTH + 1 for p in pieces)])[:-1]
    before = np.empty(n, np.int64)
    before[1:] = [ord(s[0]) for s in suffixes[:-1]]
    before[heads] = -1 - heads  # no two alike: a piece's first window always ends a run
    bwt = before[order]
    borders = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    places = order.tolist()
    sampled = np.array([_common_prefix(suffixes[places[r - 1]], suffixes[places[r]]) for r in borders.tolist()], np.int64)
    best = np.zeros(n, np.int64)
    every = np.arange(n)
    for at, edge in ((order[borders], order[0]), (order[borders - 1], order[-1])):
        value, known = np.zeros(n, np.int64), np.zeros(n, bool)
        value[at], known[at], known[edge] = sampled, True, True
        source = np.maximum.accumulate(np.where(known, every, 0))
        np.maximum(best, value[source] - (every - source), out=best)
    return best, order, suffixes


_MARK = "bin long, rel binary, first int, last int, window binary, known boolean"


def _mark_batch(*columns) -> pa.RecordBatch:
    types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [f.split()[0] for f in _MARK.split(", ")])


def _index(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the pieces held, as (bin, rel, salts, text); of dealt bins also each different window once."""
    pieces = [h[3] for h in held]
    best, order, suffixes = matching_statistics(pieces)
    marked = best >= LENGTH
    size = np.array([len(p) - LENGTH + 1 for p in pieces])
    head = np.cumsum(size) - size
    edge = np.diff(np.concatenate([[0], marked.view(np.int8), [0]]))
    runs = []  # marked runs, cut at the pieces' borders
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        p = int(np.searchsorted(head, a, "right")) - 1
        while a < b:
            c = min(b, int(head[p] + size[p]))
            runs.append((p, a - int(head[p]), c - 1 - int(head[p])))
            a, p = c, p + 1
    if runs:
        p, first, last = zip(*runs)
        none = [None] * len(runs)
        yield _mark_batch([held[i][0] for i in p], [held[i][1] for i in p], first, last, none, none)
    dealt = np.repeat([h[2] > 1 for h in held], size)
    if dealt.any():
        owner = np.repeat(np.arange(len(held)), size)
        rows, previous = [], None
        for i in order[dealt[order]].tolist():
            window = suffixes[i][:LENGTH]
            if window != previous:
                previous = window
                p = int(owner[i])
                place = i - int(head[p])
                rows.append((held[p][0], held[p][1], place, place, _digest(window.encode("latin-1")), bool(marked[i])))
        yield _mark_batch(*zip(*rows))


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    windows, group = 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bin", "salt", "salts", "rel", "piece")]
        for bin_, salt, salts, rel, piece in zip(*columns):
            if (bin_, salt) != group:
                if windows >= CHUNK:
                    yield from _index(held)
                    held, windows = [], 0
                group = bin_, salt
            elif held[-1][1] == rel:
                continue  # a row that repeats whole
            held.append((bin_, rel, salts, piece.decode("latin-1")))
            windows += len(piece) - LENGTH + 1
    if held:
        yield from _index(held)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for view, marks in zip(common.rows(batch.column("text")), batch.column("marks").to_pylist()):
            spans: list[list[int]] = []
            for first, last in sorted((m["start"] + x["first"], m["start"] + x["last"]) for m in marks or () for x in m["spans"]):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + LENGTH)
                else:
                    spans.append([first, last + LENGTH])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(view[at:a])
                at = b
            kept.update(view[at:])
            removed = sum(b - a for a, b in spans)
            rows.append((len(view), removed, len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key that equal rows share: their results are equal too."""
    did = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long")).alias("did")
    return common.texts(docs).select("doc_id", "text", did, F.xxhash64("text").alias("th"))


def _piece_marks(pieces: DataFrame) -> DataFrame:
    """(bin, rel, first, last): windows of the pieces (bin, rel, piece) that another piece of the bin has too."""
    per_bin = pieces.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).select("bin", F.ceil(F.col("c") / WIDE_GROUP).cast("int").alias("salts"))
    salt: Column = F.pmod(F.xxhash64("rel"), F.col("salts")).cast("int")
    grouped = pieces.join(per_bin, "bin").withColumn("salt", salt).repartition(common.partitions(pieces.sparkSession), "bin", "salt")
    found = common.persist(grouped.sortWithinPartitions("bin", "salt", "rel").mapInArrow(_index_batches, _MARK), "marks")
    windows = found.where("window is not null")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    across = windows.where("not known").join(twice, "window").select("bin", "rel", "first", "last")
    return found.where("window is null").select("bin", "rel", "first", "last").union(across)


def _segment_marks(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(anchor, digest, spans): first and last windows of the runs in each segment that occur elsewhere too."""
    span = F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    place = F.struct("did", "th", "start", "n")
    classes = runs.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("at"), F.min("alone").alias("alone"))
    classes = common.persist(classes, "segments")
    whole = classes.where("copies > 1").select("anchor", "digest", F.lit(0).alias("first"), (F.col("at.n") - 1).alias("last"))
    whole = whole.select("anchor", "digest", F.array(span).alias("spans"))
    per_anchor = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"), F.min("alone").alias("alone"))
    per_anchor = per_anchor.where("segments > 1 or not alone").select("anchor", (F.col("segments") > GROUP).alias("dealt"))
    wanted = classes.join(per_anchor, "anchor").select("at.did", "at.th", F.struct("anchor", "dealt", "digest", "at.start", "at.n").alias("w"))
    by_text = wanted.groupBy("did", "th").agg(F.collect_list("w").alias("wanted"))  # at most as many as the text has windows
    pieces = common.persist(_keyed(docs).join(by_text, ["did", "th"]).select("text", "wanted").mapInArrow(_slice_batches, _SEGMENT), "pieces")
    plain, dealt = pieces.where("not dealt"), pieces.where("dealt")
    # equal pieces are one; a bin of one piece held by one segment has nothing to compare
    shared = dealt.groupBy("bin", "rel").agg(F.count(F.lit(1)).alias("copies"), F.first("piece").alias("piece"))
    shared = common.persist(shared, "shared-pieces")
    several = shared.groupBy("bin").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bin")
    once = shared.join(several, "bin").select("bin", "rel", "piece")
    marks = _piece_marks(plain.select("bin", "rel", "piece").union(once))
    same = shared.where("copies > 1").select("bin", "rel", F.lit(0).alias("first"), (F.length("piece") - LENGTH).alias("last"))
    # one row per piece and per segment, however many runs it has: at most as many as its windows
    spans = marks.union(same).groupBy("bin", "rel").agg(F.collect_list(span).alias("spans"))
    moved = F.transform("spans", lambda x: F.struct((F.col("base") + x["first"]).alias("first"), (F.col("base") + x["last"]).alias("last")))
    of_pieces = dealt.select("anchor", "digest", "base", "bin", "rel").join(spans, ["bin", "rel"]).select("anchor", "digest", moved.alias("spans"))
    every = whole.union(spans.toDF("anchor", "digest", "spans")).union(of_pieces)
    return every.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    A byte goes if any LENGTH-byte string over it starts anywhere else too, in the same text or
    another; strings are judged on the input. removed lists the maximal removed byte spans. Null
    counts as empty; rows that repeat are different places, so their long texts go whole.
    """
    common.ready(docs.sparkSession)
    keyed = _keyed(docs)
    runs = common.persist(keyed.select("did", "th", "text").mapInArrow(_run_batches, _RUN), "runs")
    often = runs.groupBy("anchor").agg(F.sum(F.when(F.col("alone"), 1).otherwise(2)).alias("c")).where("c > 1").select("anchor")
    runs = common.persist(runs.join(often, "anchor"), "repeated-runs")
    marks = _segment_marks(docs, runs)
    placed = runs.join(marks, ["anchor", "digest"])
    by_text = placed.groupBy("did", "th").agg(F.collect_list(F.struct("start", "spans")).alias("marks"))  # at most as many as the text has windows
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"
    return keyed.join(by_text, ["did", "th"], "left").select("doc_id", "text", "marks").mapInArrow(_cut_batches, schema)
