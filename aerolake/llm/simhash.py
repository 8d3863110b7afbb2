"""SimHash near-duplicates, linked through the codewords of a covering code.

Two fingerprints that differ in at most 3 bits have a 32-bit half that differs in at most 1. On
each half the anchors are the words of Hamming(31, 26) x {0, 1}: 2^27 words of covering radius 1.
A fingerprint goes to every anchor within covering radius + threshold = 2 of its half (2 or 17 of
them), so the anchor nearest to one fingerprint of a linked pair holds the other too. Fingerprints
are compared per anchor only. The fingerprints of a crowded anchor, where a template makes many
texts agree on one half, are dealt on by the anchors of the other half's 16-bit quarters (one of
which differs in at most 1 bit), and those of a crowded quarter once more by the last quarter.

`near_copies` finds texts by their similarity instead: PRINTS fingerprints of the set of word
shingles, each half with its anchors. Two texts of similarity 0.8 differ in 15 bits of 100 and share
an anchor on a given half in about one case of six, so on some half in 0.95 of all cases (0.99 at
0.85). Texts of an anchor that also agree on two other fingerprints are proposed as a group. The links
of a group are those that all fingerprints together and then the exact shingle sets confirm: first
with one text of each group, then across the components that this leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

SHINGLE = 3
THRESHOLD = 3
#: Fingerprints of one anchor that a task compares before it deals them on.
CROWD = 4096
#: Rules of near_copies: words to a shingle, least similarity, fingerprints, and most bits that differ in
#: the next two fingerprints of two texts of a group, and in all of theirs (at 0.8 mostly 12 to 27, 62 to 94).
WORDS = 5
ALIKE = 0.8
PRINTS = 8
LOOSE = 26
CLOSE = 96
_SEED = 42
_LANES = np.uint64(0x0101010101010101)
_FLUSH = 1 << 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 of each word shingle of `text`, A-Z lower-cased, in lists of bounded length."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= size:
        if words:
            yield [xxhash.xxh64_intdigest(line, _SEED)]
        return
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(line)]))
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(words) - size + 1, _FLUSH):
        span = zip(starts[k : k + _FLUSH].tolist(), ends[k + size - 1 : k + size - 1 + _FLUSH].tolist())
        yield [digest(line[a:b], _SEED) for a, b in span]


def _bit_counts(hashes: np.ndarray, owner_starts: np.ndarray) -> np.ndarray:
    """Set bits per bit position, for each run of hashes that begins at owner_starts."""
    ends = np.append(owner_starts[1:], len(hashes))
    pieces = [np.arange(a, b, 255) for a, b in zip(owner_starts.tolist(), ends.tolist())]
    cuts = np.concatenate(pieces)
    first = np.cumsum([0, *map(len, pieces)])[:-1]
    out = np.empty((len(owner_starts), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)  # up to 255 to a byte
        per_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, k::8] = np.add.reduceat(per_byte, first, axis=0)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        n = batch.num_rows
        counts, totals = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        held: list[int] = []
        starts: list[int] = []
        owners: list[int] = []

        def flush() -> None:
            if held:
                np.add.at(counts, owners, _bit_counts(np.array(held, np.uint64), np.array(starts)))
                held.clear(), starts.clear(), owners.clear()

        for i, view in enumerate(common.rows(batch.column("text"))):
            for hashes in shingle_hashes(bytes(view)):
                owners.append(i)
                starts.append(len(held))
                held += hashes
                totals[i] += len(hashes)
                if len(held) >= _FLUSH:
                    flush()
        flush()
        set_bits = (2 * counts > totals[:, None]).astype(np.uint64)
        prints = (set_bits * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of each row; no word: 0; one or two words: the one shingle of all words."""
    common.ready(docs.sparkSession)
    return common.texts(docs).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _syndromes(bits: int) -> np.ndarray:
    """Hamming syndrome of each byte at each place of a word of `bits` bits; the last bit is outside the code."""
    table = np.zeros((bits // 8, 256), np.uint8)
    for place in range(bits // 8):
        for bit in range(8):
            position = 8 * place + bit + 1
            if position < bits:
                table[place, (np.arange(256) >> bit) & 1 == 1] ^= position
    return table


def _pairs(bits: int) -> np.ndarray:
    """For each syndrome s the two-bit masks i, j with i ^ j = s: they lead to codewords at distance 2."""
    return np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, bits) if i < (i ^ s)] if s else [0] * (bits // 2 - 1) for s in range(bits)], np.uint32)


_CODES = {bits: (_syndromes(bits), _pairs(bits)) for bits in (16, 32)}


def anchors(part: np.ndarray, bits: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor within distance 2 of each 32-bit half or 16-bit quarter: (index of the part, anchor)."""
    syndrome, pairs = _CODES[bits]
    octets = part.astype("<u4").view(np.uint8).reshape(-1, 4)
    s = np.bitwise_xor.reduce([syndrome[p, octets[:, p]] for p in range(bits // 8)], axis=0)
    nearest = part ^ np.where(s > 0, np.uint32(1) << (np.maximum(s, 1) - 1).astype(np.uint32), np.uint32(0))
    near = np.column_stack([nearest, nearest ^ np.uint32(1 << (bits - 1))])
    off = np.flatnonzero(s)
    far = part[off, None] ^ pairs[s[off]]
    every = np.arange(len(part))
    return np.concatenate([np.repeat(every, 2), np.repeat(off, pairs.shape[1])]), np.concatenate([near.ravel(), far.ravel()])


def _half(prints: np.ndarray, side: int) -> np.ndarray:
    return ((prints >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 4096):
            block = prints[at : at + 4096]
            for side in range(2):
                index, anchor = anchors(_half(block, side))
                keys = anchor.astype(np.int64) + (side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[index].view(np.int64))], ["key", "fp"])


def _root_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least index that each of n nodes reaches over the links a-b (and earlier labels)."""
    labels = np.arange(n) if labels is None else labels
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, labels):
            return labels
        labels = new


_SMALL = 64
_CELLS = 1 << 20


def _component_labels(keys: np.ndarray, bits: int, *prints: np.ndarray) -> np.ndarray:
    """Least index that each fingerprint reaches inside its anchor over links of `bits` bits or fewer, for sorted keys of whole groups."""
    n = len(keys)
    labels = np.arange(n)
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(begin, n))
    small = np.repeat(size <= _SMALL, size)
    a, b = [], []
    for lag in range(1, min(_SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        if not len(i):
            continue
        i = i[sum(np.bitwise_count(p[i] ^ p[i + lag]) for p in prints) <= bits]
        a.append(i)
        b.append(i + lag)
    if a:
        labels = _root_labels(n, np.concatenate(a), np.concatenate(b))
    for start, length in zip(begin[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
        group = [p[start : start + length] for p in prints]
        own = np.arange(length)
        block = max(1, _CELLS // length)
        for at in range(0, length, block):
            i, j = np.nonzero(sum(np.bitwise_count(g[at : at + block, None] ^ g[None, at:]) for g in group) <= bits)
            own = _root_labels(length, i + at, j + at, own)
        labels[start : start + length] = own + start
    return labels


def _compare(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links between fingerprints of one anchor, for sorted keys of whole groups."""
    labels = _component_labels(keys, THRESHOLD, prints)
    linked = np.flatnonzero(labels != np.arange(len(keys)))
    return prints[linked].view(np.int64), prints[labels[linked]].view(np.int64)


def _dealt(key: int, level: int, prints: np.ndarray) -> pa.RecordBatch:
    """The fingerprints of a crowded anchor, each with its next keys.

    Level 1 knows one half to be alike, and takes the anchors of both quarters of the other half.
    Level 2 knows three quarters, and takes the bytes within 1 bit of each byte of the last one.
    """
    side, mark = (key >> 32) & 3, np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    keys, index = [], []
    if level == 1:
        other = _half(prints, 1 - side)
        for quarter in range(2):
            i, anchor = anchors((other >> np.uint32(16 * quarter)) & np.uint32(0xFFFF), 16)
            keys.append(((mark ^ anchor.astype(np.uint64)) >> np.uint64(30) << np.uint64(36)) | anchor.astype(np.uint64) << np.uint64(4) | np.uint64(2 * side + quarter))
            index.append(i)
    else:
        side, quarter = (key >> 1) & 1, key & 1
        rest = (_half(prints, 1 - side) >> np.uint32(16 * (1 - quarter))) & np.uint32(0xFFFF)
        near = np.uint32(1) << np.arange(8, dtype=np.uint32)
        for place in range(2):
            octet = (rest >> np.uint32(8 * place)) & np.uint32(0xFF)
            every = np.column_stack([octet, octet[:, None] ^ near[None]])
            keys.append(mark ^ (every.ravel().astype(np.uint64) | np.uint64(place << 8)) * np.uint64(0xBF58476D1CE4E5B9))
            index.append(np.repeat(np.arange(len(prints)), 9))
    keys, index = np.concatenate(keys).view(np.int64), np.concatenate(index)
    return pa.RecordBatch.from_pydict({"a": pa.array(keys), "b": pa.array(prints[index].view(np.int64)), "level": pa.array(np.full(len(keys), level, np.int32))})


_LINK = "a long, b long, level int"


def _link_batches(level: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by anchor to links (level 0) of each anchor, or to the next keys of a crowded one's rows.

        A group that goes on in the next batch waits for it, up to CROWD fingerprints.
        """
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        crowded: int | None = None

        def links(upto: int) -> pa.RecordBatch:
            a, b = _compare(keys[:upto], prints[:upto])
            pairs = np.unique(np.column_stack([a, b]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1], "level": np.zeros(len(pairs), np.int32)})

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
            prints = np.concatenate([prints, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            while len(keys) and level < 3:  # crowded groups leave first
                begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                size = np.diff(np.append(begin, len(keys)))
                large = np.flatnonzero((size > CROWD) | (keys[begin] == crowded))
                if not len(large):
                    break
                a, n = int(begin[large[0]]), int(size[large[0]])
                crowded = int(keys[a])
                for at in range(a, a + n, CROWD):
                    yield _dealt(crowded, level, prints[at : min(at + CROWD, a + n)])
                keys, prints = np.delete(keys, np.s_[a : a + n]), np.delete(prints, np.s_[a : a + n])
                if a == len(keys):
                    break  # its rows may go on in the next batch
            upto = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if upto:
                yield links(upto)
                keys, prints = keys[upto:], prints[upto:]
        if len(keys):
            yield links(len(keys))

    return link


def links(prints: DataFrame) -> DataFrame:
    """Star links (a, b) that connect distinct fingerprints at 3 or fewer differing bits."""
    rows = prints.select("fp").mapInArrow(_anchor_batches, "key long, fp long")
    found = None
    for level in (1, 2, 3):
        grouped = rows.repartition(common.partitions(prints.sparkSession), "key").sortWithinPartitions("key")
        now = common.persist(grouped.mapInArrow(_link_batches(level), _LINK), "anchor-links")
        here = now.where("level = 0").select("a", "b")
        found = here if found is None else found.union(here)
        rows = now.where(F.col("level") == level).select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if level == 3 or rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) of each row of `docs`.

    component_id is the smallest doc_id that the row reaches over links of 3 or fewer differing
    bits. Equal fingerprints are one node, so copies of any number cost one row in the search.
    Null text counts as empty; empty texts have fingerprint zero and link like any other. Repeated
    rows are kept; a null doc_id stays and never names a component unless all its rows are null.
    """
    spark = common.ready(docs.sparkSession)
    prints = common.persist(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = graph.components(links(nodes))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def node(text: Column) -> Column:
    """A number for the words of a text, A-Z lower-cased; null counts as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.btrim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " ")))


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted hashes of the different shingles of a text."""
    hashes = [np.array(h, np.uint64) for h in shingle_hashes(text, WORDS)]
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


_RANDOM = np.random.default_rng(8).integers(0, 1 << 63, (2, PRINTS), np.uint64)
_FLIP, _TIMES = _RANDOM[0], _RANDOM[1] | np.uint64(1)


def _set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """PRINTS fingerprints for each non-empty set, one row a set."""
    size = np.array([len(x) for x in sets])
    hashes, starts = np.concatenate(sets), np.cumsum(size) - size
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = []
    for flip, times in zip(_FLIP, _TIMES):
        h = (hashes ^ flip) * times
        counts = _bit_counts(h ^ (h >> np.uint64(31)), starts)
        out.append(((2 * counts > size[:, None]).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64))
    return np.column_stack(out)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of each text with a word, as bytes."""
    for batch in batches:
        every = [shingle_set(bytes(v)) for v in common.rows(batch.column("text"))]
        kept = [i for i, x in enumerate(every) if len(x)]
        nodes = batch.column("node").to_numpy(zero_copy_only=False)[kept]
        for at in range(0, len(kept), 512):
            prints = _set_prints([every[i] for i in kept[at : at + 512]])
            yield pa.RecordBatch.from_pydict({"node": nodes[at : at + 512], "prints": pa.array([p.tobytes() for p in prints], pa.binary())})


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(common.utf8(column)[0].tobytes(), np.uint64).reshape(-1, PRINTS)


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with every anchor of each half of its fingerprints, and the next two fingerprints."""
    for batch in batches:
        nodes, every = batch.column("node").to_numpy(zero_copy_only=False), _prints(batch.column("prints"))
        for at in range(0, len(nodes), 512):
            prints = every[at : at + 512]
            for k in range(PRINTS):
                after = [prints[:, (k + j) % PRINTS] for j in (1, 2)]
                for side in range(2):
                    index, anchor = anchors(_half(prints[:, k], side))
                    columns = {"key": anchor.astype(np.int64) + ((2 * k + side) << 32), "fp": after[0][index].view(np.int64), "fp2": after[1][index].view(np.int64), "node": nodes[at : at + 512][index]}
                    yield pa.RecordBatch.from_pydict(columns)


def _group_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor to groups of texts that a chain of near fingerprints connects: each text with one of them."""
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def groups(upto: int) -> pa.RecordBatch:
        keys, one, other, nodes = (x[:upto] for x in held)
        labels = _component_labels(keys, LOOSE, one, other)
        order = nodes.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)  # the head has the least of it, in whatever group it is
        order = np.lexsort((order ^ (order >> np.uint64(29)), labels))
        start = np.append(True, labels[order][1:] != labels[order][:-1])
        head = np.repeat(nodes[order][start], np.diff(np.append(np.flatnonzero(start), upto)))
        pairs = np.unique(np.column_stack([nodes[order], head])[nodes[order] != head], axis=0)
        return pa.RecordBatch.from_pydict({"node": pairs[:, 0], "head": pairs[:, 1]})

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "fp2", "node")]
        held = [np.concatenate([h, n.view(h.dtype)]) for h, n in zip(held, new)]
        upto = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if upto:
            yield groups(upto)
            held = [x[upto:] for x in held]
    if len(held[0]):
        yield groups(len(held[0]))


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(bytes(v)).tobytes() for v in common.rows(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    places = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[places] == a).sum())
    return both / (len(a) + len(b) - both)


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (common.rows(batch.column(c)) for c in ("shingles", "others"))
        alike = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= ALIKE for x, y in zip(one, other)]
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def _close_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose fingerprints differ in few bits."""
    for batch in batches:
        apart = np.bitwise_count(_prints(batch.column("prints")) ^ _prints(batch.column("others"))).sum(axis=1)
        yield batch.select(["a", "b"]).filter(pa.array(apart <= CLOSE))


def _family_links(sets: list[np.ndarray], roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between the texts of one family that are alike and not yet of one component."""
    roots = np.unique(roots, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    starts = np.append(0, np.cumsum(size))
    shingle, places = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros(len(shingle), bool)
    for i in range(len(sets) - 1):
        mine = places[starts[i] : starts[i + 1]]
        held[mine] = True
        both = np.add.reduceat(held[places[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1], dtype=np.int64)
        held[mine] = False
        alike = both >= ALIKE * (size[i] + size[i + 1 :] - both)
        for j in (np.flatnonzero(alike & (roots[i + 1 :] != roots[i])) + i + 1).tolist():
            if roots[j] != roots[i]:
                yield i, j
                roots[roots == roots[j]] = roots[i]


def _family_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by family: one that goes on in the next batch waits for it, with its sets."""
    current, nodes, roots, sets = None, [], [], []

    def found() -> pa.RecordBatch:
        ends = list(_family_links(sets, np.array(roots))) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[x[k]] for x in ends], pa.int64()) for k in range(2)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "node", "root", "shingles")]
        for key, node_, root, shingles in zip(*columns):
            if key != current:
                yield found()
                current, nodes, roots, sets = key, [], [], []
            nodes.append(node_), roots.append(root), sets.append(np.frombuffer(shingles, np.uint64))
    yield found()


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes given."""
    read = texts.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(_set_batches, "node long, shingles binary")
    return common.persist(read.dropDuplicates(["node"]), "sets")


def _confirmed(near: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a similarity of ALIKE or more, by the exact sets: of those given only what joins what the others leave apart."""
    close = common.persist(near, "close")
    near = common.persist(graph.forest(close), "close-forest")
    common.discard(close)
    sets = _sets(near.select(F.col("a").alias("node")).union(near.select("b")), texts)
    both = near.join(sets.toDF("a", "shingles"), "a").join(sets.toDF("b", "others"), "b")
    found = common.persist(both.mapInArrow(_confirm_batches, "a long, b long"), "alike")
    common.discard(near), common.discard(sets)
    return found


def copy_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of `texts` (node, text) at a similarity of ALIKE or more.

    The texts of a proposed group are first linked with one of them, and of these links a forest is
    compared; where that leaves texts which groups connect in several components, every pair across
    these is compared too, the shingle sets of such a family in one task. So no pair of a group is left out and rows grow with the texts, but
    a large family of texts that are half alike costs its task time with the square of its size.
    """
    n = common.partitions(texts.sparkSession)
    prints = common.persist(texts.mapInArrow(_print_batches, "node long, prints binary").dropDuplicates(["node"]), "prints")
    placed = prints.mapInArrow(_place_batches, "key long, fp long, fp2 long, node long").repartition(n, "key").sortWithinPartitions("key", "node")
    grouped = placed.mapInArrow(_group_batches, "node long, head long")
    first = common.persist(grouped.select(*_ordered("node", "head")).distinct(), "grouped")
    near = first.join(prints.toDF("a", "prints"), "a").join(prints.toDF("b", "others"), "b")
    found = _confirmed(near.mapInArrow(_close_batches, "a long, b long"), texts)
    family = graph.components(graph.forest(first)).withColumnRenamed("root", "key")
    rooted = family.join(graph.components(found), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = common.persist(rooted.union(rooted.select("key", F.col("key").alias("node"), F.col("key").alias("root")).distinct()).distinct(), "rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("m")).where("l <> m").select("key")
    left = common.persist(rooted.join(split, "key", "left_semi"), "split")
    sets = _sets(left, texts)
    grouped = left.join(sets, "node").select("key", "node", "root", "shingles").repartition(n, "key").sortWithinPartitions("key", "node")
    more = common.persist(grouped.mapInArrow(_family_batches, "a long, b long"), "alike")
    for done in (prints, first, rooted, left, sets):
        common.discard(done)
    return found.union(more)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, node, component_id, keep_node) of each row of `docs`: the component of texts linked at ALIKE or more.

    component_id is the smallest doc_id of the component, keep_node the number of the words of its
    text. Texts of equal words are one node, and empty texts are copies of each other. Repeated
    rows are kept; a null doc_id stays and never names a component unless all its rows are null.
    """
    common.ready(docs.sparkSession)
    texts = docs.select("doc_id", node(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    texts = common.persist(texts, "words")
    roots = graph.components(copy_links(texts.select("node", "text")))
    named = texts.select("doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    least = named.groupBy("root").agg(F.min(order).alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("keep_node"))
    return named.join(least, "root").select("doc_id", "node", "component_id", "keep_node")
