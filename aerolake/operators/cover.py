"""Adaptive covers of large areas, and the areas that hold points.

An area becomes few cells of a grid whose cells halve from level to level. A cell is split until no edge of the area
touches it, so that it lies inside or outside as a whole, few edges touch it, or the last level is reached. Points in
an inner cell need no test; a cell on the edge carries only the edges that a ray from one of its points can meet, and
the parity of those that every such ray meets, so its test gives the very result of a test of the whole area. Areas and
points meet in an equi-join on cells; the splitting needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import settled

#: Degrees of a cell of level 0, the last level, and the edges that may touch a cell left unsplit.
SIZE = 8.0
LEVELS = 7
FEW_EDGES = 8
#: Degrees by which an edge may pass a corner and still count as touching it.
_NEAR = 1e-9


def _edges(boundary: Column) -> Column:
    """Each vertex of each ring [lon, lat] joined to the one before it, with the box of the two."""

    def edge(p: Column, q: Column) -> Column:
        px, py, qx, qy = p[0], p[1], q[0], q[1]
        box = {"west": F.least(px, qx), "east": F.greatest(px, qx), "south": F.least(py, qy), "north": F.greatest(py, qy)}
        return F.struct(px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy"), *[v.alias(k) for k, v in box.items()])

    def ring(r: Column) -> Column:
        before = F.concat(F.slice(r, F.size(r), F.lit(1)), F.slice(r, F.lit(1), F.size(r) - 1))
        return F.zip_with(r, before, edge)

    return F.flatten(F.transform(F.filter(boundary, lambda r: F.size(r) > 0), ring))


def _meets(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from a point to the east meets an edge."""
    spans = (y < e["py"]) != (y < e["qy"])
    return F.coalesce(spans & (x < (e["qx"] - e["px"]) * (y - e["py"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)) + e["px"]), F.lit(False))


def _odd(edges: Column, odd: Column, x: Column, y: Column) -> Column:
    return F.aggregate(edges, odd, lambda o, e: o != _meets(e, x, y))


def _width(level: Column) -> Column:
    return F.lit(SIZE) / F.pow(F.lit(2.0), level)


def _cell(level: Column, x: Column, y: Column) -> Column:
    """An open cell with its corner and width, and the edges that a ray from one of its points can meet."""
    size = _width(level)
    west, south = x * size, y * size
    near = F.filter("__edges", lambda e: (e["north"] >= south) & (e["south"] <= south + size) & (e["east"] >= west))
    return F.struct(level.alias("__level"), x.alias("__x"), y.alias("__y"), west.alias("__w"), south.alias("__s"), size.alias("__size"), F.lit("OPEN").alias("__state"), near.alias("__near"))


def _judging(rest: list[str], few_edges: int) -> list[list]:
    """The selections, one after another, that give cells their edges and state; cells outside are left out."""
    kept = [*rest, "__level", "__x", "__y", "__w", "__s", "__size"]
    west, south, size, open_ = F.col("__w"), F.col("__s"), F.col("__size"), F.col("__state") == "OPEN"
    east, north = west + size, south + size

    def passed(e: Column) -> Column:
        """Met by the ray of every point of the cell."""
        return (e["west"] > east) & (e["south"] <= south) & (e["north"] > north)

    def touches(e: Column) -> Column:
        sides = [(e["qx"] - e["px"]) * (y - e["py"]) - (e["qy"] - e["py"]) * (x - e["px"]) for x in (west, east) for y in (south, north)]
        boxed = (e["west"] <= east) & (e["east"] >= west) & (e["south"] <= north) & (e["north"] >= south)
        return boxed & (F.least(*sides) <= _NEAR) & (F.greatest(*sides) >= -_NEAR)

    fold = F.size(F.filter("__near", passed)) % 2 == 1
    left = F.when(open_, F.filter("__near", lambda e: ~passed(e))).otherwise(F.col("__near"))
    folded = F.struct(left.alias("__edges"), F.when(open_, F.col("__odd") != fold).otherwise(F.col("__odd")).alias("__odd"))
    touching = F.size(F.filter("__edges", touches))
    whole = F.when(_odd(F.col("__edges"), F.col("__odd"), west + size / 2, south + size / 2), "INNER").otherwise("OUTER")
    state = F.when(~open_, F.col("__state")).when(touching == 0, whole).when((touching <= few_edges) | (F.col("__level") >= LEVELS), "EDGE").otherwise("OPEN")
    return [
        [*kept, "__state", F.explode(F.array(folded)).alias("__v")],
        [*kept, "__state", "__v.*"],
        [*kept, "__edges", "__odd", F.explode(F.filter(F.array(state), lambda v: v != "OUTER")).alias("__state")],
    ]


def _selected(rows: DataFrame, selections: list[list]) -> DataFrame:
    for columns in selections:
        rows = rows.select(*columns)
    return rows


def cover(areas: DataFrame, boundary: str = "boundary", few_edges: int = FEW_EDGES) -> DataFrame:
    """One row for each cell of each area: the area's other columns, __level, __x, __y, __inner, and for cells on the edge __odd and __edges.

    `boundary` holds rings of [lon, lat]; a point is inside if an odd number of their edges lies east of it, so holes
    count as rings. Rings start with cells no smaller than half the area; an area without vertices has no cell.
    """
    rest = [x for x in areas.columns if x != boundary]
    rows = settled(areas, _edges(F.col(boundary)).alias("__edges")).drop(boundary)

    def ends(side: str) -> Column:
        return F.transform("__edges", lambda e: e[side])

    sides = [F.array_min(ends(k)).alias(f"__{k}") for k in ("west", "south")] + [F.array_max(ends(k)).alias(f"__{k}") for k in ("east", "north")]
    rows = settled(rows, *sides)
    extent = F.greatest(F.col("__east") - F.col("__west"), F.col("__north") - F.col("__south"), F.lit(1e-6))
    rows = settled(rows, F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(SIZE) / extent)).cast("int"))).alias("__level"))

    def reach(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / _width(F.col("__level"))), F.floor(F.col(high) / _width(F.col("__level"))))

    level, x, y = F.col("__level"), F.col("__x"), F.col("__y")
    rows = rows.withColumn("__x", F.explode(reach("__west", "__east"))).withColumn("__y", F.explode(reach("__south", "__north")))
    rows = rows.select(*rest, F.lit(False).alias("__odd"), F.explode(F.array(_cell(level, x, y))).alias("__v")).select(*rest, "__odd", "__v.*")
    judging = _judging(rest, few_edges)
    quarters = F.array(*[_cell(level + 1, x * 2 + i, y * 2 + j) for i in (0, 1) for j in (0, 1)])
    itself = F.array(F.struct("__level", "__x", "__y", "__w", "__s", "__size", "__state", F.col("__edges").alias("__near")))
    split = F.explode(F.when(F.col("__state") == "OPEN", quarters).otherwise(itself)).alias("__v")
    cells = _selected(rows, judging + LEVELS * [[*rest, "__odd", split], [*rest, "__odd", "__v.*"], *judging])
    inner = F.col("__state") == "INNER"
    return cells.select(*rest, "__level", "__x", "__y", inner.alias("__inner"), F.when(~inner, F.col("__odd")).alias("__odd"), F.when(~inner, F.col("__edges")).alias("__edges"))


def holding(covered: DataFrame, asked: DataFrame) -> DataFrame:
    """Each question (lat, lon) with each area that holds it; a question looks for one cell a level.

    Columns of the two sides must differ.
    """
    levels = F.array(*[F.struct(F.lit(n).alias("l"), F.floor(F.col("lon") / (SIZE / 2**n)).alias("x"), F.floor(F.col("lat") / (SIZE / 2**n)).alias("y")) for n in range(LEVELS + 1)])
    cells = asked.withColumn("__cell", F.explode(levels)).select("*", F.col("__cell.l").alias("__level"), F.col("__cell.x").alias("__x"), F.col("__cell.y").alias("__y")).drop("__cell")
    met = cells.join(covered, ["__level", "__x", "__y"])
    met = met.where(F.col("__inner") | _odd(F.col("__edges"), F.col("__odd"), F.col("lon"), F.col("lat")))
    return met.drop("__level", "__x", "__y", "__inner", "__odd", "__edges")


def first_holding(covered: DataFrame, asked: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every question once, with the values of the first area by `order` that holds it; nulls where none does.

    This gives the time zone of an airport. `key` names a question.
    """
    ranked = holding(covered, asked.select(*key, "lat", "lon")).groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("__first"))
    found = ranked.select(*key, *[F.col(f"__first.{v}").alias(v) for v in values])
    return asked.join(found, list(key), "left")
