"""Exact duplicates by an extendible-hash index on shared files.

The directory maps the leading bits of a 64-bit key to buckets. It starts with one bucket; a
bucket with more distinct keys than its capacity splits on the next bit, and the directory doubles
whenever a bucket's depth passes its own. Bucket contents are files in the shared folder, each
owner task holding one key range (consecutive buckets), sorted by key. Within a key, an owner
chains the different texts that collide and compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 20_000
#: The directory never looks at more leading bits; keys that agree on all of them share a bucket.
MAX_DEPTH = 40


class Directory:
    """Leading key bits to bucket numbers, in key order."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        """counts: distinct keys for each value of the leading log2(len(counts)) bits."""
        finest = len(counts).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(counts)])
        self.depth = 0
        split = [(0, 0)]  # (prefix, depth) of buckets that may be overfull
        done: list[tuple[int, int]] = []
        while split:
            prefix, depth = split.pop()
            width = finest - depth
            keys = below[(prefix + 1) << width] - below[prefix << width]
            if keys > capacity and depth < finest:
                self.depth = max(self.depth, depth + 1)  # doubling
                split += [(prefix << 1, depth + 1), ((prefix << 1) | 1, depth + 1)]
            else:
                done.append((prefix, depth))
        self.slots = np.zeros(1 << self.depth, np.int32)
        for number, (prefix, depth) in enumerate(sorted(done, key=lambda b: b[0] << (self.depth - b[1]))):
            width = self.depth - depth
            self.slots[prefix << width : (prefix + 1) << width] = number
        self.buckets = len(done)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int32)


def directory(docs: DataFrame, capacity: int = CAPACITY) -> Directory:
    """The directory for `docs`, from counts of distinct keys per leading bits.

    What reaches the driver is one number for each of at most 16 prefixes to an owner task, whatever
    the rows: a bucket holds at least an owner's share of them.
    """
    keys = docs.select(F.xxhash64("text").alias("key"))
    rows = keys.count()
    capacity = max(capacity, -(-rows // common.partitions(docs.sparkSession)))
    finest = min(MAX_DEPTH, max(1, rows // capacity).bit_length() + 3)
    prefix = F.shiftrightunsigned("key", 64 - finest).alias("prefix")
    found = keys.distinct().groupBy(prefix).count().collect()
    counts = np.zeros(1 << finest, np.int64)
    for row in found:
        counts[row[0]] = row[1]
    return Directory(counts, capacity)


_ENTRY = "bucket int, key long, text binary, sha256 string, members array<long>, doc_id long"
_INDEX = "bucket int, key long, place int, sha256 string, members array<long>, doc_id long"


def _entry_batches(index: Directory):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One entry for each distinct text of a batch, with the rows that hold it."""
        for batch in batches:
            keys = batch.column("key").to_pylist()
            chains: dict[tuple[int, bytes], list] = {}
            for key, view, doc_id in zip(keys, common.rows(batch.column("text")), batch.column("doc_id").to_pylist()):
                chains.setdefault((key, bytes(view)), []).append(doc_id)
            buckets = index.bucket(np.array([k for k, _ in chains], np.int64))
            columns = [
                pa.array(buckets, pa.int32()),
                pa.array([k for k, _ in chains], pa.int64()),
                pa.array([t for _, t in chains], pa.binary()),
                pa.array([hashlib.sha256(t).hexdigest() for _, t in chains]),
                pa.array(list(chains.values()), pa.list_(pa.int64())),
                pa.array([max((d for d in m if d is not None), default=None) for m in chains.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "text", "sha256", "members", "doc_id"])

    return entries


def _chain_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key: each gets its place in the chain of its key's different texts."""
    current: int | None = None
    chain: list[bytes] = []
    for batch in batches:
        places = []
        for key, view in zip(batch.column("key").to_pylist(), batch.column("text")):
            text = view.as_py()
            if key != current:
                current, chain = key, []
            for place, other in enumerate(chain):
                if other == text:
                    break
            else:
                place = len(chain)
                chain.append(text)
            places.append(place)
        columns = {"bucket": batch.column("bucket"), "key": batch.column("key"), "place": pa.array(places, pa.int32())}
        yield pa.RecordBatch.from_pydict(columns | {c: batch.column(c) for c in ("sha256", "members", "doc_id")})


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index of `docs`: bucket files in the shared folder, one owner's key range to a file.

    An entry is (bucket, key, place, sha256, members, doc_id): place is the text's number in the
    chain of different texts with that key, members the rows of one batch that hold the text.
    """
    spark = common.ready(docs.sparkSession)
    docs = common.texts(docs)
    index = directory(docs, capacity)
    entries = docs.withColumn("key", F.xxhash64("text")).mapInArrow(_entry_batches(index), _ENTRY)
    owners = min(index.buckets, common.partitions(spark))
    owner = F.floor(F.col("bucket") * F.lit(owners) / F.lit(index.buckets)).cast("int")
    owned = entries.repartitionById(owners, owner).sortWithinPartitions("bucket", "key")
    return common.persist(owned.mapInArrow(_chain_batches, _INDEX), "exact-index")


def duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The largest doc_id of a group
    stays; null doc_ids lose to any other. Rows that repeat with the same doc_id each count in
    group_size and all carry kept = true where theirs is the doc_id that stays.

    A batch sends one entry for each distinct text, so a text held by a third of the rows reaches
    its owner once per batch and streams past one copy held for comparison; the lists of its rows
    are joined to the group's totals afterwards.
    """
    index = build_index(docs, capacity)
    totals = index.groupBy("key", "place").agg(F.max("doc_id").alias("keep_id"), F.sum(F.size("members").cast("long")).alias("group_size"))
    rows = index.select("key", "place", "sha256", "members").join(totals, ["key", "place"])
    return rows.select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("sha256").alias("text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
