"""Control areas from boundary points, and altitude bounds of published airspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.rings import simplify_polygon, simplify_ring, split_antimeridian
from ...sources.text import given, number, whole

UNLIMITED_FT = 99999
TOLERANCE = 1e-3
# Kinds of class airspace that are taken, and how far their outlines may be simplified, in degrees.
CLASSES = ("CLASS_B", "CLASS_C", "CLASS_D", *(f"CLASS_E{n}" for n in range(2, 8)))
CLASS_TOLERANCE, CLASS_E_TOLERANCE = 1e-4, 1e-3
# Strata by the published altitude and type of a boundary, and their limits.
STRATA = {("HIGH", "ARTCC"): "HIGH", ("LOW", "ARTCC"): "LOW"} | {("UNLIMITED", t): t for t in ("UTA", "CTA", "FIR", "CTA/FIR")}
LIMITS = {"LOW": ((0, "SFC"), (18000, "MSL")), "HIGH": ((18000, "MSL"), (60000, "MSL")), "UTA": ((60000, "MSL"), (UNLIMITED_FT, "MSL"))}


def bound(feet: Column | int, reference: str) -> Column:
    value = feet if isinstance(feet, Column) else F.lit(feet)
    return F.struct(value.cast("int").alias("valueFt"), F.lit(reference).alias("reference"))


def shape_altitude(value: Column, unit: Column, reference: Column) -> Column:
    """The bound of a shape file's value (-9998: none), unit and reference."""
    feet = whole(value)
    surface = F.when(feet > 0, bound(feet, "AGL")).otherwise(bound(0, "SFC"))
    return (
        F.when(reference == "SFC", surface)
        .when(value.isNull() | (value == "-9998"), bound(UNLIMITED_FT, "MSL"))
        .when(unit == "FL", bound(feet * 100, "MSL"))
        .when(reference == "AGL", bound(feet, "AGL"))
        .otherwise(bound(feet, "MSL"))
    )


def special_altitude(value: Column, unit: Column, reference: Column) -> Column:
    """The bound of a special-use area's value, unit and reference; null for a schedule's placeholder."""
    word, feet = F.upper(F.trim(value)), number(value)
    ground = (reference == "SFC") | (word == "GND")
    other = (unit == "OTHER") | (reference == "OTHER")
    measured = F.when(unit == "FL", bound(feet * 100, "MSL")).when(reference == "AGL", bound(feet, "AGL")).otherwise(bound(feet, "MSL"))
    return F.when(ground, bound(0, "SFC")).when(word == "UNL", bound(UNLIMITED_FT, "MSL")).when(F.coalesce(other, F.lit(False)), F.lit(None)).otherwise(measured)


def stratum(altitude: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for (level, type_), name in STRATA.items():
        out = F.when((altitude == level) & (kind == type_), name).otherwise(out)
    return out


def largest_polygon(polygons: Column) -> Column:
    """Of several polygons the one whose outer ring has most vertices, the first of equals."""
    sized = F.transform(polygons, lambda p, i: F.struct(F.size(p[0]).alias("n"), (-i).alias("i"), p.alias("p")))
    return F.array_max(sized)["p"]


def closed_shapes(points: DataFrame, key: list[str]) -> DataFrame:
    """(key, shape, ring): points by seq, cut after each that says POINT OF BEGINNING, every ring closed."""
    order = Window.partitionBy(*key).orderBy("seq", "ord")
    ends = F.upper(F.coalesce("description", F.lit(""))).contains("POINT OF BEGINNING").cast("int")
    numbered = points.withColumn("shape", F.coalesce(F.sum(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = numbered.groupBy(*key, "shape").agg(F.array_sort(F.collect_list(F.struct("seq", "ord", F.array("lon", "lat").alias("p")))).alias("l"))
    ring = F.transform("l", lambda x: x["p"])
    rings = listed.select(*key, "shape", ring.alias("ring"))
    return rings.withColumn("ring", F.when(F.col("ring")[0] == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.col("ring")[0]))))


def control_areas(base: DataFrame, segments: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Areas of US centres and oceanic regions: one row per closed shape, cut at the 180th meridian and simplified.

    base has LOCATION_ID, LOCATION_NAME, STATE, COUNTRY_CODE; segments LOCATION_ID, ALTITUDE, TYPE,
    POINT_SEQ, LAT_DECIMAL, LONG_DECIMAL, BNDRY_PT_DESCRIP and ord. Rings of under four points are
    left out. A shape's points come together in one row, as many as one boundary has.
    """
    centres = base.where("COUNTRY_CODE = 'US'").groupBy("LOCATION_ID").agg(F.max_by(F.struct("LOCATION_NAME", "STATE"), "ord").alias("b"))
    points = segments.select(
        "ord", "LOCATION_ID", stratum(F.col("ALTITUDE"), F.col("TYPE")).alias("artccStratum"), whole(F.col("POINT_SEQ")).alias("seq"),
        number(F.col("LAT_DECIMAL")).alias("lat"), number(F.col("LONG_DECIMAL")).alias("lon"), F.col("BNDRY_PT_DESCRIP").alias("description"),
    ).where("artccStratum is not null and seq is not null and lat is not null and lon is not null")
    shapes = closed_shapes(points.join(centres.select("LOCATION_ID"), "LOCATION_ID", "left_semi"), ["LOCATION_ID", "artccStratum"])
    parts = shapes.where(F.size("ring") >= 4).select("LOCATION_ID", "artccStratum", "shape", F.posexplode(split_antimeridian("ring")).alias("part", "ring")).where(F.size("ring") >= 4)

    def limit(k: int) -> Column:
        out = bound((0, UNLIMITED_FT)[k], ("SFC", "MSL")[k])
        for name, pair in LIMITS.items():
            out = F.when(F.col("artccStratum") == name, bound(*pair[k])).otherwise(out)
        return out

    rows = parts.join(centres, "LOCATION_ID").withColumn("boundary", F.array(simplify_ring("ring", F.lit(tolerance))))
    return rows.select(
        F.lit("ARTCC").alias("type"), F.col("b.LOCATION_NAME").alias("name"), F.col("LOCATION_ID").alias("identifier"), limit(0).alias("floor"), limit(1).alias("ceiling"), "boundary",
        F.col("b.STATE").alias("state"), "artccStratum", "shape", "part",
    )


def airport_states(base: DataFrame) -> DataFrame:
    """(ARPT_ID, state) of the airports that have one; of several rows the last."""
    named = base.select("ord", given(F.col("ARPT_ID")).alias("ARPT_ID"), given(F.col("STATE_CODE")).alias("state")).where("ARPT_ID is not null and state is not null")
    return named.groupBy("ARPT_ID").agg(F.max_by("state", "ord").alias("state"))


def class_areas(features: DataFrame, states: DataFrame) -> DataFrame:
    """Class B, C, D and E areas of a shape file's features, with the state of the airport that each is named for.

    features has file, ord, IDENT, NAME, LOCAL_TYPE, the value, unit and reference of both limits (UPPER_VAL,
    UPPER_UOM, UPPER_CODE, LOWER_...), COMM_NAME, WKHR_RMK and polygons; states what `airport_states` gives.
    Of several polygons the largest is the boundary; a feature without one has no row.
    """
    chosen = features.where(F.col("LOCAL_TYPE").isin(*CLASSES) & (F.size("polygons") > 0))
    tolerance = F.when(F.col("LOCAL_TYPE").startswith("CLASS_E"), CLASS_E_TOLERANCE).otherwise(CLASS_TOLERANCE)
    limits = [shape_altitude(F.col(f"{side}_VAL"), F.col(f"{side}_UOM"), F.col(f"{side}_CODE")).alias(name) for side, name in (("LOWER", "floor"), ("UPPER", "ceiling"))]
    areas = chosen.select(
        "file", "ord", "IDENT", F.col("LOCAL_TYPE").alias("type"), F.coalesce("NAME", F.lit("")).alias("name"), F.coalesce("IDENT", F.lit("")).alias("identifier"), *limits,
        simplify_polygon(largest_polygon(F.col("polygons")), tolerance).alias("boundary"), F.col("COMM_NAME").alias("controllingFacility"), F.col("WKHR_RMK").alias("scheduleDescription"),
    )
    return areas.join(states.withColumnRenamed("ARPT_ID", "IDENT"), "IDENT", "left").drop("IDENT")
