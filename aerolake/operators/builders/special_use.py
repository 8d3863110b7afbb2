"""Special-use areas from their published documents, one XML document an area.

Spark's XML reader turns a document into nested columns; the boundary is put together from its
parts, in their order, by array functions: lines as they are, arcs and circles as polylines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import geo
from ...functions.sqlfn import register
from ...sources.text import number
from ..steps import settled
from .airspace import special_altitude

FEET_PER_NM = 6076.12
#: Pieces of the polyline of an arc.
STEPS = 64

# Kinds of special-use areas, and the postal codes of states and territories by name.
TYPES = {"MOA": "MOA", "RA": "RESTRICTED", "WA": "WARNING", "AA": "ALERT", "PA": "PROHIBITED", "NSA": "NSA"}
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS",
    "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM", "NEW YORK": "NY",
    "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV",
    "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC", "GUAM": "GU", "PUERTO RICO": "PR", "VIRGIN ISLANDS": "VI", "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}

# The part of a document that is read, from the inside out.
_MEASURE = "struct<_VALUE: string, _uom: string>"
_POINTS = "struct<pos: array<string>>"
_CENTRE = f"pointProperty: struct<Point: {_POINTS}>, radius: {_MEASURE}"
_SEGMENTS = f"struct<LineStringSegment: {_POINTS}, ArcByCenterPoint: struct<{_CENTRE}, startAngle: {_MEASURE}, endAngle: {_MEASURE}>, CircleByCenterPoint: struct<{_CENTRE}>>"
_EXTERIOR = f"struct<LinearRing: {_POINTS}, Ring: struct<curveMember: array<struct<Curve: struct<segments: {_SEGMENTS}>>>>>"
_VOLUME = f"""struct<upperLimit: {_MEASURE}, upperLimitReference: string, lowerLimit: {_MEASURE}, lowerLimitReference: string,
    horizontalProjection: struct<Surface: struct<patches: struct<PolygonPatch: struct<exterior: {_EXTERIOR}>>>>>"""
_AREA = f"""struct<name: string, designator: string,
    geometryComponent: array<struct<AirspaceGeometryComponent: struct<operation: string, theAirspaceVolume: struct<AirspaceVolume: {_VOLUME}>>>>,
    annotation: array<struct<Note: struct<propertyName: string, translatedNote: struct<LinguisticNote: struct<note: string>>>>>,
    extension: array<struct<AirspaceExtension: struct<suaType: string, administrativeArea: string>>>>"""
_UNIT = "struct<type: string, designator: string>"
DOCUMENT = f"""hasMember array<struct<Airspace: struct<timeSlice: struct<AirspaceTimeSlice: {_AREA}>>, Unit: struct<timeSlice: struct<UnitTimeSlice: {_UNIT}>>>>"""


def _first(items: Column, value) -> Column:
    """The first of the values of an array's items that isn't null."""
    return F.get(F.filter(F.transform(items, value), lambda x: x.isNotNull()), F.lit(0))


def _point(position: Column) -> Column:
    """[lon, lat] of `lon lat`; null where either is missing."""
    halves = F.split(F.trim(position), r"\s+")
    lon, lat = number(F.get(halves, F.lit(0))), number(F.get(halves, F.lit(1)))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.array(lon, lat))


def _line(segment: Column) -> Column:
    return F.filter(F.transform(segment["pos"], _point), lambda p: p.isNotNull())


def _part(member: Column) -> Column:
    """One part of a boundary: the points of a line, or the centre, radius in NM and angles of an arc or circle."""
    segments = member["Curve"]["segments"]
    line, arc, circle = (segments[c] for c in ("LineStringSegment", "ArcByCenterPoint", "CircleByCenterPoint"))
    turn = line.isNull() & arc.isNull()

    def of(read) -> Column:
        return F.when(turn, read(circle)).when(line.isNull(), read(arc))

    radius = of(lambda x: number(x["radius"]["_VALUE"]))
    in_feet = of(lambda x: F.coalesce(x["radius"]["_uom"] == "FT", F.lit(False)))
    return F.struct(
        F.when(line.isNotNull(), _line(line)).alias("points"), of(lambda x: _point(F.get(x["pointProperty"]["Point"]["pos"], F.lit(0)))).alias("centre"), F.when(in_feet, radius / FEET_PER_NM).otherwise(radius).alias("nm"),
        F.when(turn, F.lit(0.0)).otherwise(number(arc["startAngle"]["_VALUE"])).alias("start"), F.when(turn, F.lit(360.0)).otherwise(number(arc["endAngle"]["_VALUE"])).alias("end"),
    )


def _drawn(part: Column) -> Column:
    """Points of a part; an arc is a polyline counterclockwise, an end not beyond its start a turn later. One that lacks something has none."""
    north = part["nm"] / 60
    narrow = F.cos(F.radians(part["centre"][1]))
    east = north / F.when(narrow == 0, F.lit(1.0)).otherwise(narrow)
    sweep = F.when(part["end"] <= part["start"], part["end"] + 360).otherwise(part["end"]) - part["start"]

    def at(step: Column) -> Column:  # as the function discretize_arc, which can't be called on the parts of an array
        angle = F.radians(part["start"] + step * sweep / STEPS)
        return F.array(part["centre"][0] + F.cos(angle) * east, part["centre"][1] + F.sin(angle) * north)

    whole = part["centre"].isNotNull() & part["nm"].isNotNull() & part["start"].isNotNull() & part["end"].isNotNull()
    drawn = F.when(part["points"].isNotNull(), part["points"]).when(whole, F.transform(F.sequence(F.lit(0), F.lit(STEPS)), at))
    return F.coalesce(drawn, F.array().cast("array<array<double>>"))


def _schedule(area: Column) -> Column:
    """What a legal definition says after `Times of use.`, up to the agency's section or the end."""

    def said(annotation: Column) -> Column:
        note = F.when(annotation["Note"]["propertyName"] == "legalDefinitionType", annotation["Note"]["translatedNote"]["LinguisticNote"]["note"])
        after = F.regexp_extract(note, r"(?is)times of use\.(.*)", 1)
        return F.nullif(F.trim(F.regexp_replace(F.get(F.split(after, r"(?i)(controlling|using) agency"), F.lit(0)), r"^\s+|\s+$", "")), F.lit(""))

    return _first(area["annotation"], said)


def build(documents: DataFrame, content: str = "content") -> DataFrame:
    """Areas of documents: their other columns, type, name, identifier, floor, ceiling, boundary, state, controllingFacility, scheduleDescription.

    The volume is that of the first component whose operation is BASE, else of the first. Documents
    of other kinds, and those without altitudes or a boundary, give no row; so do broken ones.
    """
    register(documents.sparkSession, geo.FUNCTIONS, "geo")
    others = [c for c in documents.columns if c != content]
    parsed = F.from_xml(F.col(content), DOCUMENT, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})["hasMember"]
    read = settled(documents.select(*others, content), parsed.alias("members")).drop(content)
    area = _first(F.col("members"), lambda m: m["Airspace"]["timeSlice"]["AirspaceTimeSlice"])
    facility = _first(F.col("members"), lambda m: F.when(m["Unit"]["timeSlice"]["UnitTimeSlice"]["type"] == "ARTCC", m["Unit"]["timeSlice"]["UnitTimeSlice"]["designator"]))
    read = settled(read, area.alias("area"), facility.alias("controllingFacility")).drop("members").where("area is not null")
    components = F.transform("area.geometryComponent", lambda g: g["AirspaceGeometryComponent"])
    base = F.coalesce(F.get(F.filter(components, lambda g: g["operation"] == "BASE"), F.lit(0)), F.get(components, F.lit(0)))
    read = settled(read, base["theAirspaceVolume"]["AirspaceVolume"].alias("volume"))
    exterior = F.col("volume.horizontalProjection.Surface.patches.PolygonPatch.exterior")
    kind = _first(F.col("area.extension"), lambda e: e["AirspaceExtension"]["suaType"])
    place = _first(F.col("area.extension"), lambda e: e["AirspaceExtension"]["administrativeArea"])
    linear = F.when(exterior["LinearRing"].isNotNull(), F.array(F.struct(_line(exterior["LinearRing"]).alias("points"), *[F.lit(None).cast(t).alias(c) for c, t in (("centre", "array<double>"), ("nm", "double"), ("start", "double"), ("end", "double"))])))
    parts = F.coalesce(linear, F.transform(exterior["Ring"]["curveMember"], _part))
    read = settled(read, parts.alias("parts"), kind.alias("kind"), place.alias("place"), _schedule(F.col("area")).alias("scheduleDescription"))
    read = settled(read, F.flatten(F.transform("parts", _drawn)).alias("ring"))

    def limit(side: str, name: str) -> Column:
        value = F.col(f"volume.{side}Limit")
        unit, reference = F.coalesce(value["_uom"], F.lit("")), F.coalesce(F.col(f"volume.{side}LimitReference"), F.lit(""))
        return F.when(value["_VALUE"].isNotNull(), special_altitude(value["_VALUE"], unit, reference)).alias(name)

    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    codes = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    out = read.where(F.size("ring") >= 4).select(
        *others, F.try_element_at(known, F.col("kind")).alias("type"), F.coalesce("area.name", F.lit("")).alias("name"), F.coalesce("area.designator", F.lit("")).alias("identifier"),
        limit("lower", "floor"), limit("upper", "ceiling"), F.array(F.call_function("close_ring", F.col("ring"))).alias("boundary"), F.try_element_at(codes, F.upper("place")).alias("state"), "controllingFacility", "scheduleDescription",
    )
    return out.where("type is not null and floor is not null and ceiling is not null")
