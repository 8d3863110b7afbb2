"""Flight-plan routes: tokens, their meaning, and distances.

What a token means depends on what came before it. Joins give every token its candidates (airways
of that name, airport, procedures, fix, navaid); one fold over a route's tokens then carries the
last waypoint and the last airport along and picks. Routes are short, so a route is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.sqlfn import register
from . import procedures as procs
from .airways import _slice_between
from .lookup import first_by_key, last_by_key

_POINT = "struct<label: string, lat: double, lon: double, next: double>"
_SPEED = "struct<speedKt: int, speedKmPerHr: int, mach: double, flightLevel: int, altitudeFt: int>"
_ELEMENT = f"struct<type: string, raw: string, ident: string, entryFix: string, exitFix: string, speed: {_SPEED}, points: array<{_POINT}>>"
_PLACE = "struct<ident: string, lat: double, lon: double>"
_WAYPOINT = "struct<identifier: string, name: string, lat: double, lon: double, distanceToNextNm: double>"
_LEG = "struct<fixIdentifier: string, lat: double, lon: double>"
_AIRWAYS = f"array<array<{_WAYPOINT}>>"
_PROCEDURES = f"array<struct<ord: long, airports: array<string>, type: string, identifier: string, legs: array<{_LEG}>>>"


def tokens(routes: DataFrame, key: str = "route_id", route: str = "route") -> DataFrame:
    """One row per token: key, pos, raw (upper case) and nextRaw; blank routes have none."""
    parts = F.split(F.upper(F.trim(F.regexp_replace(route, r"\s+", " "))), " ")
    rows = routes.where(F.trim(F.regexp_replace(route, r"\s+", " ")) != "").select(key, parts.alias("parts"))
    rows = rows.select(key, "parts", F.posexplode("parts").alias("pos", "raw"))
    return rows.select(key, "pos", "raw", F.get("parts", F.col("pos") + 1).alias("nextRaw"))


def coordinate(raw: Column) -> Column:
    """struct(lat, lon) of degrees, or degrees and minutes, with hemispheres; else null."""
    fine, coarse = r"^(\d{2})(\d{2})([NS])(\d{3})(\d{2})([EW])$", r"^(\d{2})([NS])(\d{3})([EW])$"

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(raw, pattern, n)

    def number(pattern: str, n: int) -> Column:
        return part(pattern, n).cast("double")

    def sign(pattern: str, n: int, minus: str) -> Column:
        return F.when(part(pattern, n) == minus, -1.0).otherwise(1.0)

    minutes = F.struct(
        (sign(fine, 3, "S") * (number(fine, 1) + number(fine, 2) / 60)).alias("lat"), (sign(fine, 6, "W") * (number(fine, 4) + number(fine, 5) / 60)).alias("lon")
    )
    degrees = F.struct((sign(coarse, 2, "S") * number(coarse, 1)).alias("lat"), (sign(coarse, 4, "W") * number(coarse, 3)).alias("lon"))
    return F.when(raw.rlike(fine), minutes).when(raw.rlike(coarse), degrees)


def speed_altitude(raw: Column) -> Column:
    """struct of speed in its unit and level or altitude, from tokens like N0450F350; else null."""
    pattern = r"^([NKM])(\d{3,4})([FA])(\d{3,4})$"
    unit, kind = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 3)
    value, level = F.regexp_extract(raw, pattern, 2).try_cast("int"), F.regexp_extract(raw, pattern, 4).try_cast("int")
    fields = F.struct(
        F.when(unit == "N", value).alias("speedKt"),
        F.when(unit == "K", value).alias("speedKmPerHr"),
        F.when(unit == "M", value / 100.0).alias("mach"),
        F.when(kind == "F", level).alias("flightLevel"),
        F.when(kind == "A", level * 100).alias("altitudeFt"),
    )
    return F.when(raw.rlike(pattern), fields)


def _places(data: DataFrame | None, field: str, last: bool, name: str) -> DataFrame | None:
    """key and a place struct: the last (hash index) or the first of each identifier."""
    if data is None:
        return None
    keyed = (last_by_key if last else first_by_key)(data, F.col(field))
    ident = F.coalesce("icao", "faaId") if "icao" in data.columns else F.col(field)
    return keyed.select("key", F.struct(ident.alias("ident"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).cast(_PLACE).alias(name))


def _with(rows: DataFrame, found: DataFrame | None, name: str, type_: str, on: str = "raw") -> DataFrame:
    """Left join on the token; a provider that isn't given finds nothing."""
    if found is None:
        return rows.withColumn(name, F.lit(None).cast(type_))
    return rows.join(found, F.col(on) == F.col("key"), "left").drop("key")


def candidates(toks: DataFrame, key: str, airports=None, navaids=None, fixes=None, airways=None, procedures=None) -> DataFrame:
    """Every token with all that it could stand for."""
    rows = toks
    for data, field, last, name in ((airports, "icao", True, "icao_"), (airports, "faaId", True, "faa_"), (fixes, "identifier", False, "fix"), (navaids, "identifier", False, "navaid")):
        rows = _with(rows, _places(data, field, last, name), name, _PLACE)
    rows = rows.withColumn("airport", F.coalesce("icao_", "faa_")).drop("icao_", "faa_")
    ways = None
    if airways is not None:
        wp = F.transform("waypoints", lambda w: F.struct(w["identifier"].alias("identifier"), w["name"].alias("name"), w["lat"].cast("double").alias("lat"), w["lon"].cast("double").alias("lon"), w["distanceToNextNm"].cast("double").alias("distanceToNextNm")))
        grouped = airways.select(F.upper("designation").alias("key"), "ord", wp.alias("w")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "w"))).alias("a"))
        ways = grouped.select("key", F.transform("a", lambda a: a["w"]).cast(_AIRWAYS).alias("airways"))
    rows = _with(rows, ways, "airways", _AIRWAYS)
    dot = F.instr("raw", ".")
    rows = rows.withColumn("ident", F.when(dot > 0, F.substring_index("raw", ".", 1)).otherwise(F.col("raw")))
    rows = rows.withColumn("transitionName", F.when(dot > 0, F.expr("substring(raw, instr(raw, '.') + 1)")))
    if procedures is None:
        return rows.withColumn("procedures", F.lit(None).cast(_PROCEDURES))
    named = procedures.select(F.upper("identifier").alias("key"), "ord", "airports", "type", "identifier")
    asked = rows.select("ident", "transitionName").distinct().join(named, F.col("ident") == F.col("key"))
    asked = asked.withColumn("airportId", F.get("airports", F.lit(0)))
    plain = asked.select("ident", "transitionName", F.col("ord").alias("candidate"), "airportId")
    legs = procs.expand(procedures, plain).select("ident", "transitionName", "candidate", F.transform("legs", lambda g: F.struct(g["fixIdentifier"].alias("fixIdentifier"), g["lat"].cast("double").alias("lat"), g["lon"].cast("double").alias("lon"))).alias("legs"))
    met = asked.alias("a").join(legs.alias("l"), (F.col("a.ident") == F.col("l.ident")) & F.col("a.transitionName").eqNullSafe(F.col("l.transitionName")) & (F.col("a.ord") == F.col("l.candidate")), "left")
    empty = F.array().cast(f"array<{_LEG}>")
    one = F.struct(F.col("a.ord").alias("ord"), F.col("a.airports").alias("airports"), F.col("a.type").alias("type"), F.col("a.identifier").alias("identifier"), F.coalesce("l.legs", empty).alias("legs"))
    lists = met.groupBy(F.col("a.ident").alias("i"), F.col("a.transitionName").alias("t")).agg(F.array_sort(F.collect_list(one), lambda x, y: (x["ord"] - y["ord"]).cast("int")).cast(_PROCEDURES).alias("procedures"))
    return rows.join(lists, (F.col("ident") == F.col("i")) & F.col("transitionName").eqNullSafe(F.col("t")), "left").drop("i", "t")


def _element(kind: str, t: Column, points: Column | None = None, ident: Column | None = None, entry: Column | None = None, exit_: Column | None = None, speed: Column | None = None) -> Column:
    null = F.lit(None)
    none = F.array()
    return F.struct(
        F.lit(kind).alias("type"),
        t["raw"].alias("raw"),
        (null if ident is None else ident).cast("string").alias("ident"),
        (null if entry is None else entry).cast("string").alias("entryFix"),
        (null if exit_ is None else exit_).cast("string").alias("exitFix"),
        (null if speed is None else speed).cast(_SPEED).alias("speed"),
        (none if points is None else points).cast(f"array<{_POINT}>").alias("points"),
    )


def _one_point(label: Column, place: Column) -> Column:
    return F.array(F.struct(label.alias("label"), place["lat"].alias("lat"), place["lon"].alias("lon"), F.lit(None).cast("double").alias("next")))


def _airway_points(waypoints: Column) -> Column:
    """Points of a stretch of airway; all but the last keep the published distance to the next."""

    def point(w: Column, i: Column) -> Column:
        published = F.when(i < F.size(waypoints) - 1, w["distanceToNextNm"])
        return F.struct(F.coalesce(w["identifier"], w["name"]).alias("label"), w["lat"].alias("lat"), w["lon"].alias("lon"), published.alias("next"))

    return F.transform(waypoints, point)


def _step(s: Column, t: Column) -> Column:
    def state(element: Column, waypoint: Column, airport: Column | None = None, skip: bool = False) -> Column:
        return F.struct(
            F.concat(s["elements"], F.array(element.cast(_ELEMENT))).alias("elements"),
            waypoint.cast("string").alias("waypoint"),
            (s["airport"] if airport is None else airport).cast("string").alias("airport"),
            F.lit(skip).alias("skip"),
        )

    nothing = F.lit(None)
    stretches = F.filter(F.transform(t["airways"], lambda w: _slice_between(w, s["waypoint"], t["nextRaw"])), lambda w: w.isNotNull())
    stretch = F.when(s["waypoint"].isNotNull() & t["nextRaw"].isNotNull(), F.get(stretches, F.lit(0)))
    here = F.filter(t["procedures"], lambda p: F.exists(p["airports"], lambda a: F.upper(a) == F.upper(s["airport"])))
    chosen = F.coalesce(F.get(here, F.lit(0)), F.get(t["procedures"], F.lit(0)))
    legs = F.filter(chosen["legs"], lambda g: g["fixIdentifier"].isNotNull())
    placed = F.filter(legs, lambda g: g["lat"].isNotNull() & g["lon"].isNotNull())
    leg_points = F.transform(placed, lambda g: F.struct(g["fixIdentifier"].alias("label"), g["lat"].alias("lat"), g["lon"].alias("lon"), F.lit(None).cast("double").alias("next")))
    last_leg = F.coalesce(F.get(legs, F.size(legs) - 1)["fixIdentifier"], s["waypoint"])
    skipped = F.struct(s["elements"].alias("elements"), s["waypoint"].alias("waypoint"), s["airport"].alias("airport"), F.lit(False).alias("skip"))

    def procedure(kind: str) -> Column:
        return state(_element(kind, t, leg_points, chosen["identifier"]), last_leg)

    return (
        F.when(s["skip"], skipped)
        .when(t["raw"] == "DCT", state(_element("direct", t), s["waypoint"]))
        .when(t["coordinate"].isNotNull(), state(_element("coordinate", t, _one_point(t["raw"], t["coordinate"])), nothing))
        .when(t["speed"].isNotNull(), state(_element("speedAltitude", t, speed=t["speed"]), s["waypoint"]))
        .when(
            F.size(t["airways"]) > 0,
            F.when(
                stretch.isNotNull(),
                state(_element("airway", t, _airway_points(stretch), t["raw"], s["waypoint"], t["nextRaw"]), t["nextRaw"], skip=True),
            ).otherwise(state(_element("unresolved", t), nothing)),
        )
        .when(t["airport"].isNotNull(), state(_element("airport", t, _one_point(t["raw"], t["airport"]), t["airport"]["ident"]), t["raw"], t["airport"]["ident"]))
        .when(chosen["type"] == "SID", procedure("sid"))
        .when(chosen["type"] == "STAR", procedure("star"))
        .when(t["fix"].isNotNull(), state(_element("waypoint", t, _one_point(t["raw"], t["fix"]), t["fix"]["ident"]), t["raw"]))
        .when(t["navaid"].isNotNull(), state(_element("waypoint", t, _one_point(t["raw"], t["navaid"]), t["navaid"]["ident"]), t["raw"]))
        .otherwise(state(_element("unresolved", t), nothing))
    )


def resolve(routes: DataFrame, key: str = "route_id", route: str = "route", **providers: DataFrame) -> DataFrame:
    """The elements of each route: key and an array of (type, raw, ident, entryFix, exitFix, speed, points).

    Providers (airports, navaids, fixes, airways, procedures) are optional; without one its tokens
    stay unresolved. Blank routes have an empty array.
    """
    rows = candidates(tokens(routes, key, route), key, **providers)
    rows = rows.withColumn("coordinate", coordinate(F.col("raw"))).withColumn("speed", speed_altitude(F.col("raw")))
    fields = ["pos", "raw", "nextRaw", "coordinate", "speed", "airways", "airport", "procedures", "fix", "navaid"]
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: a["pos"] - b["pos"]).alias("tokens"))
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast(f"array<{_ELEMENT}>").alias("elements"), none.alias("waypoint"), none.alias("airport"), F.lit(False).alias("skip"))
    folded = lists.select(key, F.aggregate("tokens", start, _step)["elements"].alias("elements"))
    return routes.select(key).join(folded, key, "left").withColumn("elements", F.coalesce("elements", F.array().cast(f"array<{_ELEMENT}>")))


def points(resolved: DataFrame, key: str = "route_id") -> DataFrame:
    """Points of each route in order, a run within 1e-9 degrees of each other collapsed to one.

    The survivor is the run's first; it takes the first published distance that the run has.
    """
    flat = resolved.select(key, F.posexplode(F.flatten(F.transform("elements", lambda e: e["points"]))).alias("n", "p")).select(key, "n", "p.*")
    order = Window.partitionBy(key).orderBy("n")
    near = (F.abs(F.col("lat") - F.lag("lat").over(order)) < 1e-9) & (F.abs(F.col("lon") - F.lag("lon").over(order)) < 1e-9)
    runs = flat.withColumn("run", F.sum(F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).over(order))
    run = runs.groupBy(key, "run").agg(F.min_by(F.struct("label", "lat", "lon"), "n").alias("p"), F.min_by("next", F.when(F.col("next").isNotNull(), F.col("n"))).alias("next"))
    return run.select(key, F.col("run").cast("int").alias("point"), "p.*", "next")


def legs(resolved: DataFrame, key: str = "route_id") -> DataFrame:
    """Legs between neighbouring points: the published distance where there is one, else the great circle."""
    register(resolved.sparkSession, geo.FUNCTIONS, "geo")
    order = Window.partitionBy(key).orderBy("point")
    rows = points(resolved, key)
    for column in ("label", "lat", "lon"):
        rows = rows.withColumn(f"to_{column}", F.lead(column).over(order))
    rows = rows.where(F.col("to_lat").isNotNull())
    rows = rows.withColumn("distanceNm", F.coalesce("next", F.call_function("distance_nm", F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))))
    running = F.sum("distanceNm").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, F.col("point").alias("leg"), F.col("label").alias("from"), F.col("to_label").alias("to"), "distanceNm", running.alias("cumulativeDistanceNm"))


def route_distance(resolved: DataFrame, key: str = "route_id", ground_speed: Column | None = None) -> DataFrame:
    """Total distance, time at a ground speed above zero, and unresolved tokens of each route."""
    total = legs(resolved, key).groupBy(key).agg(F.sum("distanceNm").alias("totalDistanceNm"), F.count(F.lit(1)).alias("legs"))
    unresolved = F.transform(F.filter("elements", lambda e: e["type"] == "unresolved"), lambda e: e["raw"])
    rows = resolved.withColumn("unresolved", unresolved).join(total, key, "left")
    rows = rows.withColumn("totalDistanceNm", F.coalesce("totalDistanceNm", F.lit(0.0))).withColumn("legs", F.coalesce("legs", F.lit(0)).cast("long"))
    speed = F.lit(None).cast("double") if ground_speed is None else ground_speed
    return rows.withColumn("estimatedTimeEnrouteHrs", F.when(speed > 0, F.col("totalDistanceNm") / speed)).drop("elements")
