"""Spatial joins as equi-joins on grid cells.

A nested-loop join compares every question with every row. Here each side is laid out on a grid of
rows and columns: the data set's rows in the cell that holds them (points) or in all
cells that their box touches (areas), the question in its own cell or in those within reach, so
Catalyst sees an equi-join that shuffles or broadcasts like any other and AQE splits hot cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.sqlfn import register
from .lookup import first_n

RADIUS_NM = 30.0
NEAREST_LIMIT = 10
#: The finest of the grids that points are laid on has 2^FINEST cells to 360 degrees: a third of a mile each.
FINEST = 16
#: Miles of a degree of the sphere that distances are taken on, and a little more.
NM_PER_DEGREE = 60.041
#: Area boxes over more cells than this are matched by latitude row alone: few, but wide.
WIDE_CELLS = 256


def _floor(c: Column) -> Column:
    return F.floor(c).cast("int")


def _cell(c: Column, half: float, level: Column) -> Column:
    """Number of the cell that holds a coordinate, of 2^level cells to 360 degrees."""
    return F.floor((c + half) * F.pow(F.lit(2.0), level) / 360.0).cast("int")


def _column(lon: Column, level: Column) -> Column:
    return F.pmod(_cell(lon, 180.0, level), F.pow(F.lit(2.0), level).cast("int"))


def _finest_crowded(rows: DataFrame, asked: DataFrame, coarsest: int, least: int) -> DataFrame:
    """(__fy, __fx, __crowded): for each finest cell with a question the finest level at which the cell around it holds `least` rows."""
    fine = F.lit(FINEST)
    levels = F.explode(F.sequence(F.lit(coarsest), fine)).alias("m")

    def above(cells: DataFrame, *more: str) -> DataFrame:
        spread = cells.select("__fy", "__fx", *more, levels)
        step = F.pow(F.lit(2.0), fine - F.col("m"))
        return spread.select("*", *[F.floor(F.col(f"__f{a}") / step).cast("int").alias(a) for a in ("y", "x")])

    held = above(rows.groupBy("__fy", "__fx").agg(F.count(F.lit(1)).alias("n")), "n").groupBy("m", "y", "x").agg(F.sum("n").alias("n"))
    wanted = above(asked.select("__fy", "__fx").distinct())
    return wanted.join(held.where(F.col("n") >= least).drop("n"), ["m", "y", "x"]).groupBy("__fy", "__fx").agg(F.max("m").alias("__crowded"))


def nearest(
    data: DataFrame,
    asked: DataFrame,
    key: Sequence[str],
    radius_nm: float = RADIUS_NM,
    limit: int = NEAREST_LIMIT,
    where: Column | None = None,
) -> DataFrame:
    """The nearest rows of `data` within the radius of each question (lat, lon), with distanceNm and rank.

    `key` names a question; `data` needs ord, lat and lon. The radius holds for the raw distance;
    rows rank by the distance rounded to hundredths, then by input order. Columns of the question
    come first; lat and lon of the data set are rowLat and rowLon.

    The smallest cell around a question that holds `limit` rows bounds how far it must look: to the
    cell's farthest corner, or to the radius. So what a question meets follows from the limit, not
    from how many rows lie within the radius. Of rows at one point only the first `limit` can be found.
    """
    register(data.sparkSession, geo.FUNCTIONS, "geo")
    if where is not None:
        data = data.where(where)
    fine = F.lit(FINEST)
    rows = first_n(data.where("lat is not null and lon is not null"), ["lat", "lon"], ["ord"], limit).drop("rank").withColumnsRenamed({"lat": "rowLat", "lon": "rowLon"})
    reach = radius_nm / 60.0 + 1e-9
    coarsest = min(FINEST, max(0, math.floor(math.log2(360.0 / reach)) - 1))
    finest = {"__fy": _cell(F.col("lat"), 90.0, fine), "__fx": _column(F.col("lon"), fine)}
    placed = rows.select(_cell(F.col("rowLat"), 90.0, fine).alias("__fy"), _column(F.col("rowLon"), fine).alias("__fx"))
    crowded = _finest_crowded(placed, asked.where("lat is not null and lon is not null").withColumns(finest), coarsest, limit)
    cells = asked.withColumns(finest).join(crowded, ["__fy", "__fx"], "left").drop("__fy", "__fx")

    # a path that climbs and turns evenly to the cell's farthest corner is no shorter than the great circle
    size = F.lit(360.0) / F.pow(F.lit(2.0), F.col("__crowded"))
    south, west = _cell(F.col("lat"), 90.0, F.col("__crowded")) * size - 90.0, _cell(F.col("lon"), 180.0, F.col("__crowded")) * size - 180.0
    up, along = F.greatest(F.col("lat") - south, south + size - F.col("lat")), F.greatest(F.col("lon") - west, west + size - F.col("lon"))
    widest = F.cos(F.radians(F.when((south < 0) & (south + size > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + size)))))
    # one hundredth and more is added, as rows of one rounded distance rank by their order
    corner = F.sqrt(up * up + along * along * widest * widest) * NM_PER_DEGREE + 0.05
    cells = cells.withColumn("__within", F.coalesce(F.least(corner, F.lit(float(radius_nm))), F.lit(float(radius_nm))))
    tall = F.col("__within") / 60.0 + 1e-9
    # a parallel shortens with latitude: the widest column reach is at the far edge of the band, which may hold a pole
    edge = F.abs(F.col("lat")) + tall
    columns = F.when(edge >= 90.0, 180.0).otherwise(F.least(tall / F.cos(F.radians(edge)) * 1.02, F.lit(180.0)))
    cells = cells.withColumn("__tall", tall).withColumn("__wide", columns)
    # cells as large as the reach or larger: at most three to a side
    level = F.least(fine, F.greatest(F.floor(F.log2(F.lit(360.0) / F.greatest("__tall", "__wide"))), F.lit(0))).cast("int")
    cells = cells.withColumn("__m", level)
    m = F.col("__m")
    low, high = _cell(F.col("lon") - F.col("__wide"), 180.0, m), _cell(F.col("lon") + F.col("__wide"), 180.0, m)
    around = F.pow(F.lit(2.0), m).cast("int")
    xs = F.array_distinct(F.transform(F.sequence(low, F.least(high, low + around - 1)), lambda x: F.pmod(x, around)))
    ys = F.sequence(_cell(F.col("lat") - F.col("__tall"), 90.0, m), _cell(F.col("lat") + F.col("__tall"), 90.0, m))
    used = cells.select("__m").distinct()
    cells = cells.withColumn("__y", F.explode(ys)).withColumn("__x", F.explode(xs)).drop("__crowded", "__tall", "__wide")
    laid = rows.withColumn("__m", F.explode(F.sequence(F.lit(0), fine))).join(F.broadcast(used), "__m", "left_semi")
    laid = laid.withColumns({"__y": _cell(F.col("rowLat"), 90.0, m), "__x": _column(F.col("rowLon"), m)})
    met = cells.join(laid, ["__m", "__y", "__x"]).drop("__m", "__y", "__x")
    met = met.withColumn("__raw", geo_distance("lat", "lon", "rowLat", "rowLon")).where(F.col("__raw") <= F.col("__within"))
    met = met.withColumn("distanceNm", F.floor(F.col("__raw") * 100 + 0.5) / 100).drop("__raw", "__within")
    return first_n(met, key, ["distanceNm", "ord"], limit)


def geo_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.call_function("distance_nm", F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2))


def _bound(bound: str) -> Column:
    """Feet of an altitude bound; null above ground, where they are unknown."""
    reference = F.col(f"{bound}.reference")
    return F.when(reference == "SFC", F.lit(0.0)).when(reference == "MSL", F.col(f"{bound}.valueFt").cast("double"))


def altitude_matches(altitude: Column) -> Column:
    """floor <= altitude <= ceiling, both inclusive; unknown bounds pass."""
    return F.coalesce(altitude >= _bound("floor"), F.lit(True)) & F.coalesce(altitude <= _bound("ceiling"), F.lit(True))


def parse_features(features: DataFrame) -> DataFrame:
    """Polygon features with a ring of four points or more, and the box of the outer ring."""
    register(features.sparkSession, geo.FUNCTIONS, "geo")
    usable = features.where((F.col("geometry.type") == "Polygon") & (F.size(F.col("geometry.coordinates")[0]) >= 4) & F.col("properties").isNotNull())
    flat = usable.select("ord", "properties.*", F.col("geometry.coordinates").alias("boundary"))
    return with_box(flat.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("identifier", F.coalesce("identifier", F.lit(""))))


def with_box(areas: DataFrame) -> DataFrame:
    return areas.withColumn("box", F.call_function("ring_bounding_box", F.col("boundary")[0]))


def containing(areas: DataFrame, asked: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Areas (boundary, box, floor, ceiling, type) that hold each question (lat, lon, altitudeFt).

    Only the outer ring counts. An area lies in every cell its box touches; a box over more than
    WIDE_CELLS cells lies in its latitude rows instead, and questions look in both places.
    """
    register(areas.sparkSession, geo.FUNCTIONS, "geo")
    if types is not None:
        areas = areas.where(F.col("type").isin(*types))
    ys = F.sequence(_floor(F.col("box.minLat")), _floor(F.col("box.maxLat")))
    xs = F.sequence(_floor(F.col("box.minLon")), _floor(F.col("box.maxLon")))
    placed = areas.withColumn("__y", F.explode(ys)).withColumn("__xs", F.when(F.size(ys) * F.size(xs) <= WIDE_CELLS, xs).otherwise(F.array(F.lit(1000))))
    placed = placed.withColumn("__x", F.explode("__xs")).drop("__xs")
    cells = asked.withColumn("__y", _floor(F.col("lat"))).withColumn("__x", F.explode(F.array(_floor(F.col("lon")), F.lit(1000))))
    met = cells.join(placed, ["__y", "__x"]).drop("__y", "__x")
    inside = F.call_function("point_in_box", F.col("lon"), F.col("lat"), F.col("box")) & F.call_function("point_in_ring", F.col("lon"), F.col("lat"), F.col("boundary")[0])
    return met.where(inside & altitude_matches(F.col("altitudeFt")))


def by_airport(areas: DataFrame, asked: DataFrame, question: str = "identifier", types: Sequence[str] | None = None) -> DataFrame:
    """Areas named for each identifier, route traffic centres left out."""
    chosen = areas.where(F.col("type") != "ARTCC")
    if types is not None:
        chosen = chosen.where(F.col("type").isin(*types))
    keyed = chosen.withColumn("__key", F.upper("identifier")).drop(*([question] if question == "identifier" else []))
    return asked.join(keyed, F.upper(question) == F.col("__key")).drop("__key")


def by_artcc(areas: DataFrame, asked: DataFrame, question: str = "identifier", stratum: str | None = None) -> DataFrame:
    """Route traffic centre areas of each identifier, of one stratum if given."""
    chosen = areas.where(F.col("type") == "ARTCC")
    if stratum is not None:
        chosen = chosen.where(F.col("artccStratum") == stratum)
    keyed = chosen.withColumn("__key", F.upper("identifier")).drop(*([question] if question == "identifier" else []))
    return asked.join(keyed, F.upper(question) == F.col("__key")).drop("__key")


def overlapping(areas: DataFrame, key: str) -> DataFrame:
    """Pairs of areas (a.key < b.key) whose boxes overlap and of which one holds the other's centroid."""
    register(areas.sparkSession, geo.FUNCTIONS, "geo")
    box = F.col("box")
    placed = areas.select(F.col(key).alias("k"), "boundary", box).withColumn("y", F.explode(F.sequence(_floor(box.minLat), _floor(box.maxLat))))
    placed = placed.withColumn("x", F.explode(F.sequence(_floor(F.col("box.minLon")), _floor(F.col("box.maxLon")))))
    a, b = placed.alias("a"), placed.alias("b")
    pairs = a.join(b, (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.k") < F.col("b.k")))
    pairs = pairs.where(F.call_function("boxes_overlap", F.col("a.box"), F.col("b.box")))
    pairs = pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.col("a.boundary").alias("p"), F.col("b.boundary").alias("q")).dropDuplicates(["a", "b"])
    return pairs.where(F.call_function("polygons_overlap", F.col("p"), F.col("q"))).select("a", "b")
