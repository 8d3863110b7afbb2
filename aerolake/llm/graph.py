"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := parent.setdefault(top, top)) != top:
            top = above
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        joins = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            one, other = root(a), root(b)
            joins.append(one != other)
            if one != other:
                parent[max(one, other)] = min(one, other)
        yield batch.filter(pa.array(joins, pa.bool_()))


def forest(edges: DataFrame) -> DataFrame:
    """Of the links (a, b) in each task only those that join what the others there leave apart: the components stay the same."""
    return edges.select("a", "b").mapInArrow(_forest_batches, "a long, b long")


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    onto = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return least.select("a", F.col("m").alias("b")).union(onto).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of longs to rows (node, root): root is the least node that each linked node reaches.

    Minima are pre-aggregated before each shuffle and joined back, so a hub's links spread over
    tasks; links are only ever held as tables, each round's in the shared folder. Self-links and
    repeated links count once; a node without links has no row.
    """
    edges = common.persist(edges.where("a <> b").select("a", "b").distinct(), "links")
    before = _stamp(edges)
    while before[0]:
        after = common.persist(_small_star(_large_star(edges)), "stars")
        now = _stamp(after)
        common.discard(edges)
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
