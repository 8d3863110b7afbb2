"""Airways from fixed-width route files: segment rows joined with point rows, nested in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...sources.text import Layout, code, fields

# The published layouts of the two files' records, and their codes.
_LIMITS = ("minimumEnrouteAltitude", "minimumEnrouteAltitudeOpposite", "minimumCrossingAltitude", "minimumCrossingAltitudeOpposite", "gnssMinimumEnrouteAltitude", "gnssMinimumEnrouteAltitudeOpposite")


def _segment(key: Layout, shift: int, width: int, starts: tuple[int, ...], rest: Layout) -> Layout:
    """A segment record: its key, its distances and courses `shift` further right, and its limits with their directions."""
    out = key | {
        "distanceToNextNm": (45 + shift, 6, "number"),
        "magneticCourseDeg": (57 + shift, 6, "number"),
        "magneticCourseOppositeDeg": (63 + shift, 6, "number"),
        "segmentDistanceNm": (69 + shift, 6, "number"),
    }
    for name, start in zip(_LIMITS, starts):
        out[f"{name}Ft"] = (start, 5, "whole")
        out[f"{name}Direction"] = (start + 5, 7 if "Crossing" in name else width, "text")
    return out | rest


AWY_KEY: Layout = {"designation": (5, 5, "text"), "typeCode": (10, 1, "text"), "seq": (11, 5, "whole")}
AWY1 = _segment(AWY_KEY, 0, 6, (75, 86, 111, 123, 218, 229), {
    "maximumAuthorizedAltitudeFt": (97, 5, "whole"), "minimumObstructionClearanceAltitudeFt": (102, 5, "whole"), "discontinued": (107, 1, "X"),
    "changeoverDistanceNm": (108, 3, "whole"), "signalGap": (135, 1, "Y"), "usAirspaceOnly": (136, 1, "Y"), "artccId": (142, 3, "text"), "dogleg": (302, 1, "Y"),
})
AWY2: Layout = AWY_KEY | {
    "name": (16, 30, "text"), "facilityType": (46, 19, "text"), "state": (80, 2, "text"), "icaoRegionCode": (82, 2, "text"), "latText": (84, 14, "text"),
    "lonText": (98, 14, "text"), "minimumReceptionAltitudeFt": (112, 5, "whole"), "navaidIdentifier": (117, 4, "text"),
}
ATS_KEY: Layout = {"designation": (5, 14, "text"), "typeCode": (20, 1, "text"), "seq": (21, 5, "whole")}
ATS1 = _segment(ATS_KEY, 10, 7, (85, 97, 123, 135, 247, 259), {
    "maximumAuthorizedAltitudeFt": (109, 5, "whole"), "minimumObstructionClearanceAltitudeFt": (114, 5, "whole"), "discontinued": (119, 1, "X"),
    "changeoverDistanceNm": (120, 3, "whole"), "signalGap": (147, 1, "Y"), "usAirspaceOnly": (148, 1, "Y"), "artccId": (154, 3, "text"), "dogleg": (343, 1, "Y"),
})
ATS2: Layout = ATS_KEY | {
    "name": (26, 40, "text"), "facilityType": (66, 25, "text"), "state": (106, 2, "text"), "icaoRegionCode": (108, 2, "text"), "latText": (110, 14, "text"),
    "lonText": (124, 14, "text"), "minimumReceptionAltitudeFt": (138, 5, "whole"), "navaidIdentifier": (143, 4, "text"),
}
LETTER_TYPES = {"V": "VICTOR", "J": "JET", "Q": "RNAV_Q", "T": "RNAV_T", "G": "GREEN", "R": "RED", "A": "AMBER", "B": "BLUE"}
PREFIX_TYPES = {"AT": "ATLANTIC", "BF": "BAHAMA", "PA": "PACIFIC", "PR": "PUERTO_RICO"}
REGIONS = {"A": "ALASKA", "H": "HAWAII"}
_STATIONS = "VOR|NDB|TACAN|DME"
_POINTS = ["REP-PT", "AWY-INTXN", "COORDN-FIX", "MIL-REP-PT", "FIX", "TURN-PT"]


def degrees(text: Column) -> Column:
    """Degrees, to 6 places, of a position like 32-32-25.59N."""
    part = [F.regexp_extract(text, r"(\d+)-(\d+)-(\d+\.?\d*)\s*([NSEW])", k) for k in range(1, 5)]
    size = part[0].try_cast("double") + part[1].try_cast("double") / 60 + part[2].try_cast("double") / 3600
    signed = F.when(part[3].isin("S", "W"), -size).otherwise(size)
    return F.floor(signed * 1e6 + 0.5) / 1e6


def point_type(facility: Column, name: Column) -> Column:
    """NAVAID, WAYPOINT, FIX, BORDER or OTHER from a point's facility type and name."""
    upper = F.upper(facility)
    blank = F.when(name.rlike("BORDER|MEXICAN|CANADIAN"), "BORDER").otherwise("OTHER")
    return F.when(facility.isNull(), blank).when(upper.rlike(_STATIONS), "NAVAID").when(upper == "WAY-PT", "WAYPOINT").when(upper.isin(_POINTS), "FIX").otherwise("OTHER")


def _records(lines: DataFrame, mark: str, layout: Layout) -> DataFrame:
    """The records of one kind; of those with one key the last stays."""
    read = lines.where(F.col("value").startswith(mark)).select("ord", *fields(F.col("value"), layout))
    keys = ["designation", "typeCode", "seq"]
    last = read.groupBy("designation", F.coalesce("typeCode", F.lit("")).alias("typeCode"), "seq").agg(F.min("ord").alias("first"), F.max_by(F.struct(*[c for c in layout if c not in keys]), "ord").alias("r"))
    return last.select(*keys, F.col("first").alias("ord"), "r.*")


def waypoints(lines: DataFrame, marks: tuple[str, str], layouts: tuple[Layout, Layout]) -> DataFrame:
    """One row per segment whose point has a position: key, ord and the waypoint's fields."""
    segment = _records(lines, marks[0], layouts[0])
    point = _records(lines, marks[1], layouts[1]).drop("ord")
    both = segment.join(point, ["designation", "typeCode", "seq"])
    both = both.withColumns({"lat": degrees(F.col("latText")), "lon": degrees(F.col("lonText")), "waypointType": point_type(F.col("facilityType"), F.col("name"))})
    named = F.coalesce("navaidIdentifier", F.when(F.col("waypointType").isin("FIX", "WAYPOINT"), F.col("name")))
    out = both.where("lat is not null and lon is not null").withColumns({
        "name": F.coalesce("name", F.lit("")), "identifier": named, "navaidFacilityType": F.when(F.col("waypointType") == "NAVAID", F.col("facilityType")),
        "distanceToNextNm": F.coalesce("distanceToNextNm", "segmentDistanceNm"),
    })
    return out.drop("latText", "lonText", "facilityType", "navaidIdentifier", "segmentDistanceNm")


def _nested(points: DataFrame, type_: Column) -> DataFrame:
    inner = [c for c in points.columns if c not in ("designation", "typeCode", "ord")]
    grouped = points.withColumn("type", type_).where("type is not null").groupBy("designation", "typeCode", "type")
    listed = grouped.agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct(*inner))).alias("waypoints"))
    region = F.coalesce(code(F.col("typeCode"), REGIONS), F.lit("US"))
    return listed.select("ord", "designation", "type", region.alias("region"), "waypoints")


def federal(lines: DataFrame) -> DataFrame:
    """Airways (ord, designation, type, region, waypoints) of the federal route file's lines (ord, value).

    A segment without its point, or whose point has no position, is left out, and so is an airway
    of an unknown letter or without waypoints. An airway's waypoints are nested by sequence number;
    they are as many as one airway has.
    """
    points = waypoints(lines, ("AWY1", "AWY2"), (AWY1, AWY2))
    return _nested(points.select("seq", *[c for c in points.columns if c != "seq"]), code(F.substring("designation", 1, 1), LETTER_TYPES))


def oceanic(lines: DataFrame) -> DataFrame:
    """As `federal`, for the file of other air traffic service routes, named by a prefix."""
    points = waypoints(lines, ("ATS1", "ATS2"), (ATS1, ATS2))
    return _nested(points.select("seq", *[c for c in points.columns if c != "seq"]), code(F.substring("designation", 1, 2), PREFIX_TYPES))
