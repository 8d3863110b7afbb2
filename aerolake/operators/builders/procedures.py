"""Terminal procedures from 132-column navigation records: legs, their positions, routes and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...sources.text import code, given, whole
from ..steps import settled

# Codes of the published record format.
PROCEDURES = {"D": "SID", "E": "STAR", "F": "IAP"}
CATEGORIES = {"EA": "FIX", "PC": "FIX", "D ": "NAVAID", "DB": "NAVAID", "PN": "NAVAID", "PI": "NAVAID", "PA": "AIRPORT", "PG": "RUNWAY"}
TERMINATORS = "IF TF CF DF FA FC FD FM CA CD CI CR RF AF VA VD VI VM VR PI HA HF HM".split()
ALTITUDE_RULES = list("@+-BCGHIJVXY")
SPEED_RULES = list("@+-")
COMMON = {"SID": list("25MN"), "STAR": list("258MN")}
APPROACHES = {
    "I": "ILS", "L": "LOC", "B": "LOC_BC", "R": "RNAV", "H": "RNAV_RNP", "V": "VOR", "D": "VOR_DME", "S": "VOR", "N": "NDB", "Q": "NDB_DME",
    "T": "TACAN", "J": "GLS", "G": "IGS", "X": "LDA", "U": "SDF", "P": "GPS", "F": "FMS", "M": "MLS", "W": "MLS", "Y": "MLS",
}


def _at(start: int, width: int = 1) -> Column:
    """Columns of a record, from 1, blanks kept."""
    return F.substring("value", start, width)


def _degrees(start: int, digits: int, positive: str, negative: str) -> Column:
    """Degrees, to 6 places, of a position in the record like N40382300 or W073462900."""
    number = [_at(start + 1, digits), _at(start + 1 + digits, 2), _at(start + 3 + digits, 4)]
    size = number[0].try_cast("int") + number[1].try_cast("int") / 60 + number[2].try_cast("int") / 360000
    sign = F.when(_at(start) == positive, 1).when(_at(start) == negative, -1)
    return F.when(_at(start).isin(positive, negative), F.floor(sign * size * 1e6 + 0.5) / 1e6)


def _latitude(start: int) -> Column:
    return _degrees(start, 2, "N", "S")


def _longitude(start: int) -> Column:
    return _degrees(start, 3, "E", "W")


def altitude(text: Column) -> Column:
    """Feet of FL180 or 05000."""
    trimmed = F.trim(text)
    return F.when(trimmed.startswith("FL"), whole(F.substring(trimmed, 3, 9)) * 100).otherwise(whole(trimmed))


def precision(text: Column) -> Column:
    """Miles of a required precision: two digits and the negated power of ten."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) == 3, whole(F.substring(trimmed, 1, 2)) * F.pow(F.lit(10.0), -whole(F.substring(trimmed, 3, 1))))


def _leg_records(records: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The primary leg records of procedures, unread but for the procedure that each belongs to."""
    kind = code(_at(13), {c: n for c, n in PROCEDURES.items() if kinds is None or n in kinds})
    read = records.where((_at(1) == "S") & (_at(5) == "P") & _at(39).isin("0", "1"))
    named = read.select("ord", "value", kind.alias("type"), given(_at(7, 4)).alias("airport"), given(_at(14, 6)).alias("identifier"))
    return named.where("type is not null and airport is not null and identifier is not null")


def _with_positions(records: DataFrame, index: DataFrame) -> DataFrame:
    """Leg records with lat and lon of their fix: they meet the index unread, a leg's fields are wider than its record."""
    fix = given(_at(30, 5))
    keyed = records.withColumn("__fix", fix).withColumn("__region", F.when(fix.isNotNull(), given(_at(35, 2)))).withColumn("__section", _at(37, 2))
    met = (F.col("__fix") == F.col("ident")) & (F.col("__region") == F.col("region")) & (F.col("__section") == F.col("section"))
    return keyed.join(index, met, "left").drop("__fix", "__region", "__section", "ident", "region", "section")


def _legs(read: DataFrame) -> DataFrame:
    """One row per leg of the leg records, with its fields in place of the record."""
    fix, described, course, spent = given(_at(30, 5)), _at(40, 4), F.trim(_at(71, 4)), F.trim(_at(75, 4))
    navaid, rule, limit, role = given(_at(51, 4)), _at(83), altitude(_at(85, 5)), _at(43)
    speed, speed_rule = whole(_at(100, 3)), F.when(_at(118) == " ", "-").otherwise(_at(118))
    centre = F.when(F.trim(_at(48, 2)) == "RF", given(_at(107, 5)))
    true = F.lit(True)
    columns = {
        "seq": whole(_at(27, 3)), "routeType": _at(20), "transition": F.trim(_at(21, 5)),
        "startsMissed": _at(42) == "M", "pathTerminator": F.trim(_at(48, 2)), "fixIdentifier": fix, "icaoRegionCode": F.when(fix.isNotNull(), given(_at(35, 2))),
        "category": F.when(fix.isNotNull(), code(_at(37, 2), CATEGORIES)), "isFlyover": F.when(F.substring(described, 2, 1).isin("B", "Y"), true),
        "isInitialApproachFix": F.when(role.isin("A", "C", "D"), true), "isIntermediateFix": F.when(role == "B", true), "isFinalApproachFix": F.when(role == "F", true),
        "isFinalApproachCourseFix": F.when(role == "I", true), "isMissedApproachPoint": F.when(role == "M", true), "turnDirection": F.when(_at(44).isin("L", "R"), _at(44)),
        "rnpNm": precision(_at(45, 3)), "recommendedNavaid": navaid, "recommendedNavaidIcaoRegionCode": F.when(navaid.isNotNull(), given(_at(55, 2))),
        "arcRadiusNm": whole(_at(57, 6)) / 10000, "thetaDeg": whole(_at(63, 4)) / 10, "rhoNm": whole(_at(67, 4)) / 10, "courseDeg": whole(course) / 10,
        "courseIsTrue": F.when(course.endswith("T") & whole(course).isNotNull(), true), "distanceNm": F.when(~spent.startswith("T"), whole(spent) / 10),
        "holdTimeMin": F.when(spent.startswith("T"), whole(F.substring(spent, 2, 3)) / 10),
        "altitudeConstraint": F.when(rule.isin(ALTITUDE_RULES) & limit.isNotNull(), F.struct(rule.alias("descriptor"), limit.alias("primaryFt"), altitude(_at(90, 5)).alias("secondaryFt"))),
        "speedConstraint": F.when((speed > 0) & speed_rule.isin(SPEED_RULES), F.struct(speed_rule.alias("descriptor"), speed.alias("speedKt"))),
        "centerFix": centre, "centerFixIcaoRegionCode": F.when(centre.isNotNull(), given(_at(113, 2))),
    }
    read = settled(read, *[c.alias(n) for n, c in columns.items()], apart=True).drop("value")
    return read.where(F.col("seq").isNotNull() & F.col("pathTerminator").isin(TERMINATORS))


def fix_index(records: DataFrame) -> DataFrame:
    """(ident, region, section, lat, lon) of every fix, navaid, airport and runway record; the last of a key stays.

    Beacons are asked for by either of two codes. A radio station without a position of its own has
    that of its distance equipment.
    """
    enroute, radio, beacon = (_at(5) == "E") & (_at(6) == "A"), (_at(5) == "D") & (_at(6) == " "), (_at(5) == "D") & (_at(6) == "B")
    port = _at(5) == "P"
    terminal, station, airport = port & _at(13).isin("C", "G"), port & _at(13).isin("I", "N"), port & (_at(13) == "A")
    section = F.when(enroute, F.array(F.lit("EA"))).when(radio, F.array(F.lit("D "))).when(beacon, F.array(F.lit("DB"), F.lit("PN"))).otherwise(F.array(F.concat(F.lit("P"), _at(13))))
    own = given(_at(11, 2))
    region = F.when(airport, own).when(terminal | station, F.coalesce(given(_at(20, 2)), own)).otherwise(given(_at(20, 2)))
    ident = given(F.when(airport, _at(7, 4)).when(enroute | terminal, _at(14, 5)).otherwise(_at(14, 4)))
    read = records.where((_at(1) == "S") & _at(22).isin("0", "1") & (enroute | radio | beacon | terminal | station | airport))
    read = read.select("ord", ident.alias("ident"), region.alias("region"), section.alias("section"), _latitude(33).alias("a"), _longitude(42).alias("b"), F.when(radio, _latitude(56)).alias("c"), F.when(radio, _longitude(65)).alias("d"))
    first = F.col("a").isNotNull() & F.col("b").isNotNull()
    point = F.struct(F.when(first, F.col("a")).otherwise(F.col("c")).alias("lat"), F.when(first, F.col("b")).otherwise(F.col("d")).alias("lon")).alias("p")
    every = read.select("ord", "ident", "region", F.explode("section").alias("section"), point)
    whole_ = F.when(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull(), F.col("ord"))
    last = every.where("ident is not null and region is not null").groupBy("ident", "region", "section").agg(F.max_by("p", whole_).alias("p"))
    return last.where("p.lat is not null and p.lon is not null").select("ident", "region", "section", "p.lat", "p.lon")


def approach_type(route_type: Column) -> Column:
    return code(route_type, APPROACHES)


def runway(identifier: Column) -> Column:
    """The runway of an approach's identifier: two digits, and L, R or C, after its first letter."""
    return F.nullif(F.regexp_extract(identifier, r"^.(\d{2}[LRC]?)", 1), F.lit(""))


def _name(kind: Column, identifier: Column, approach: Column) -> Column:
    """ILS RWY 04L, or VOR-A where there is no runway; departures and arrivals keep their identifier."""
    label, way = F.coalesce(approach, F.substring(identifier, 1, 1)), runway(identifier)
    rest = F.regexp_replace(F.trim(F.regexp_replace(F.substring(identifier, 2, 9), "^[A-Z]*-?", "-")), "^-+", "-")
    circling = F.when(F.length(rest) > 1, F.concat(label, rest)).otherwise(identifier)
    return F.when(kind != "IAP", identifier).when(way.isNotNull(), F.concat(label, F.lit(" RWY "), way)).otherwise(circling)


def build(lines: DataFrame, kinds: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Procedures of a navigation file's lines (ord, value), in no order.

    Columns: ord (of the first record), airport, name, identifier, type, approachType, runway,
    commonRoutes (array of legs, airports), transitions (array of name, legs), missedApproach (legs).
    Lines under 132 columns and records that can't be read are left out. Legs are ordered by
    sequence number, equal ones by their place in the file. In an approach, the legs of a common
    route from the first one marked as the beginning of the missed approach on belong to that.
    The lists are as long as one procedure. `kinds` asks for procedures of these types alone, `fields` for
    these fields of the legs alone, an empty list for legs without any, that can be counted: positions are
    looked up only where lat or lon is among them.
    """
    records = lines.where(F.length("value") >= 132)
    read, whole_key = _leg_records(records, kinds), ["airport", "identifier", "type"]
    if fields is None or {"lat", "lon"} & set(fields):
        # a few fixes have most of the legs: these are dealt anew, by procedure, before they are read
        read = _with_positions(read, fix_index(records)).repartition(*whole_key)
    legs = _legs(read)
    names = sorted(legs.columns, key=lambda c: c in ("lat", "lon"))
    outer = {"ord", "type", "airport", "identifier", "routeType", "transition", "seq", "startsMissed"}
    approach = F.col("type") == "IAP"
    shared = F.when(approach, ~F.col("routeType").isin("A", "Z")).otherwise(F.when(F.col("type") == "SID", F.col("routeType").isin(COMMON["SID"])).otherwise(F.col("routeType").isin(COMMON["STAR"])))
    kind = F.when(approach & (F.col("routeType") == "Z"), "missed").when(shared, "common").otherwise("transition")
    bucket = F.when(approach & (F.col("routeType") == "A"), F.col("transition")).when(approach, F.col("routeType")).otherwise(F.concat_ws("::", "routeType", "transition"))
    leg = F.struct(*[c for c in names if c not in outer and (fields is None or c in fields)])
    entry = F.struct("seq", "ord", "startsMissed", "transition", leg.alias("leg"))
    legs = settled(legs, kind.alias("kind"), bucket.alias("bucket"), entry.alias("entry"), apart=True)
    routes = legs.groupBy(*whole_key, "kind", "bucket").agg(F.min("ord").alias("ord"), F.min_by("routeType", "ord").alias("routeType"), F.array_sort(F.collect_list("entry")).alias("entries"))
    begins = F.array_position(F.transform("entries", lambda e: e["startsMissed"]), True)
    cut = F.when((F.col("kind") == "common") & approach & (begins > 0), begins - 1).otherwise(F.size("entries")).cast("int")
    routes = settled(routes, F.when(F.col("kind") == "missed", 0).otherwise(cut).alias("cut"))
    last = F.transform(F.slice("entries", F.col("cut") + 1, F.size("entries")), lambda e: F.struct(e["seq"].alias("seq"), (F.col("kind") == "common").alias("rank"), F.col("ord").alias("route"), e["ord"].alias("ord"), e["leg"].alias("leg")))
    stay = F.slice("entries", F.lit(1), F.col("cut"))
    route = F.struct(F.col("ord"), F.col("entries")[0]["transition"].alias("name"), F.transform(stay, lambda e: e["leg"]).alias("legs"))
    routes = settled(routes, last.alias("late"), route.alias("route"))

    def listed(which: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == which, F.col("route"))))

    first = F.min_by(F.when(F.col("kind") == "common", F.col("routeType")), F.when(F.col("kind") == "common", F.col("ord")))
    whole_ = routes.groupBy(*whole_key).agg(F.min("ord").alias("ord"), first.alias("final"), listed("common").alias("c"), listed("transition").alias("t"), F.array_sort(F.flatten(F.collect_list("late"))).alias("m"))
    found = F.when(F.col("type") == "IAP", approach_type(F.col("final")))
    missed = F.when((F.col("type") == "IAP") & (F.size("m") > 0), F.struct(F.transform("m", lambda e: e["leg"]).alias("legs")))
    whole_ = settled(whole_, found.alias("approachType"))
    out = settled(
        whole_, _name(F.col("type"), F.col("identifier"), F.col("approachType")).alias("name"),
        F.when(F.col("type") == "IAP", runway(F.col("identifier"))).alias("runway"),
        F.transform("c", lambda r: F.struct(r["legs"].alias("legs"), F.array(F.col("airport")).alias("airports"))).alias("commonRoutes"),
        F.transform("t", lambda r: F.struct(r["name"].alias("name"), r["legs"].alias("legs"))).alias("transitions"), missed.alias("missedApproach"),
    )
    return out.select("ord", "airport", "name", "identifier", "type", "approachType", "runway", "commonRoutes", "transitions", "missedApproach")
