"""AIRMETs, cut into sections.

A bulletin is cut where a section begins: a hazard, a potential of wind shear, an outlook and its areas, freezing
levels, or a statement that there is nothing. An area belongs to the last outlook before it, also behind a stop.
Hazards, wind shear and areas are read alike; each step's results are fields of the next step's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c
from .phrases import AREA_ENDS, after, altitude_ft, altitude_range_of, area_points, levels, said, says, sentence, word

# fixed values: kinds of hazard as they are written, longer ones first, and named
HAZARDS = {
    "STG SFC WNDS": "STRONG_SURFACE_WIND", "STG SFC WND": "STRONG_SURFACE_WIND", "MTN OBSCN": "MOUNTAIN_OBSCURATION", "SFC WND": "STRONG_SURFACE_WIND", "TURB": "TURBULENCE",
    "LLWS": "LOW_LEVEL_WIND_SHEAR", "IFR": "IFR", "ICE": "ICING",
}
# fixed values: patterns that begin a section, and its kind
OPENERS = {
    rf"AIRMET (?:{'|'.join(HAZARDS)})\b": "HAZARD", r"LLWS POTENTIAL\b": "SHEAR", r"OTLK VALID\b": "OUTLOOK", r"AREA \d+ ?\.{3}": "AREA", r"FRZLVL ?\.{3}": "FREEZING", r"NO SIGNIFICANT\b": "NIL",
}
_CUTS = rf"\b(?={'|'.join(OPENERS)})"


_HEAD = r"\bAIRMET (SIERRA|TANGO|ZULU) (?:UPDT (\d+) )?FOR (.+?) VALID UNTIL (\d{4,6})"
# fixed values: the values of an outlook's area
_OUTLOOK = ("hazardType", "states", "boundedBy", "altitudes", "condition", "description", "conditions")

#: What a section says, by name: a struct, or columns.
Values = Column | dict[str, Column]


def _with_head(rows: DataFrame) -> DataFrame:
    return settled(rows, c.found(F.col("__text"), _HEAD, 0).alias("__head"))


def _section(text: Column, outlook: Column) -> Column:
    """A section's kind, its text, and the validity of the outlook that it stands behind."""
    kind = F.lit("HEAD")
    for opener, name in OPENERS.items():
        kind = F.when(text.rlike(f"^{opener}"), name).otherwise(kind)
    return F.struct(kind.alias("kind"), text.alias("text"), F.when(outlook.startswith("OTLK VALID "), F.substring_index(outlook, " ", -1)).alias("valid"))


def _with_sections(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` with __sections of a squeezed text, in order."""

    def pieces(part: Column) -> Column:
        cut = F.transform(F.split(part, _CUTS), lambda s: F.trim(F.regexp_replace(s, r"( \.)+ ?$", "")))
        return F.filter(cut, lambda s: s != "")

    rows = settled(rows, F.transform(F.split(F.coalesce(text, F.lit("")), r"(?=\bOTLK VALID\b)"), lambda p: F.struct(F.trim(p).alias("said"), pieces(p).alias("pieces"))).alias("__parts"))
    owned = F.flatten(F.transform("__parts", lambda p: F.transform(p["pieces"], lambda s: _section(s, F.substring_index(p["said"], " ", 3)))))
    return settled(rows, owned.alias("__sections")).drop("__parts")


def sections(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row for each section of each bulletin: its place from 0, kind, text, and the validity of its outlook as written."""
    rest = [x for x in reports.columns if x != raw]
    rows = _with_sections(settled(reports, c.squeezed(F.col(raw)).alias("__text")), F.col("__text"))
    return rows.select(*rest, F.posexplode("__sections").alias("place", "__s")).select(*rest, "place", "__s.*")


def _points(words: Column) -> Column:
    """The points behind BOUNDED BY, up to the first word of weather."""
    span = F.coalesce(F.get(F.split(after(words, "BOUNDED BY"), f" (?:{'|'.join(AREA_ENDS)}) ", 2), F.lit(0)), F.lit(""))
    return F.filter(F.transform(F.split(span, "-"), lambda p: F.trim(p)), lambda p: p != "")


def _spans(tail: Column) -> dict[str, Column]:
    """From the words that follow CONDS: the status, and the written times of its development, continuation and end."""

    def span(name: str, link: str) -> Column:
        """The two ends of the time that follows a word, with or without a link between."""
        first = word(tail, name)
        return F.split(F.when(first == link, word(tail, f"{name} {link}")).otherwise(first), "-")

    return {
        "status": F.substring_index(F.ltrim(tail), " ", 1), "developing": span("DVLPG", "AFT"), "ending": span("ENDG", "BY"), "beyond": word(tail, "CONTG BYD"), "through": word(tail, "THRU"), "isAfter": says(tail, "DVLPG AFT"),
    }


def _times(x: Values) -> dict[str, Column]:
    """What `_spans` wrote, as times."""

    def end(parts: str, n: int) -> Column:
        return c.day_time_of(F.get(x[parts], F.lit(n)))

    return {
        "developingFrom": end("developing", 0), "developingTo": end("developing", 1), "continuingBeyond": c.day_time_of(x["beyond"]), "through": c.day_time_of(x["through"]),
        "endingFrom": end("ending", 0), "endingTo": end("ending", 1),
    }


def _conditions(x: Values) -> Column:
    """DEVELOPING, CONTINUING or ENDING with all its times, and the start and end that they come to."""
    status, t = x["status"], x["times"]
    named = F.when(status == "DVLPG", "DEVELOPING").when(status == "CONTG", "CONTINUING").when(status == "ENDG", "ENDING")
    start = F.when(status == "DVLPG", t["developingFrom"]).when(status == "CONTG", t["continuingBeyond"]).when(t["endingTo"].isNotNull(), t["endingFrom"])
    stop = F.when(status == "DVLPG", F.coalesce(t["through"], t["developingTo"])).otherwise(F.coalesce(t["through"], t["endingTo"], t["endingFrom"]))
    each = [t[name].alias(name) for name in ("developingFrom", "developingTo", "continuingBeyond", "through", "endingFrom", "endingTo")]
    return F.when(named.isNotNull(), F.struct(named.alias("status"), *each, start.alias("startTime"), stop.alias("endTime"), x["isAfter"].alias("isAfter")))


def _condition(words: Column) -> Column:
    """The weather that an area has: turbulence or ice by degree, low cloud and sight, hidden mountains, wind, or wind shear."""
    out = F.when(says(words, "LLWS EXP"), "LLWS EXP").when(says(words, "LLWS DUE TO"), F.concat(F.lit("LLWS DUE TO "), word(words, "LLWS DUE TO")))
    for phrase in ("MOD TURB", "SEV TURB", "MOD ICE", "SEV ICE"):
        out = F.when(says(words, phrase), phrase).otherwise(out)
    low = F.slice(F.split(F.ltrim(after(words, "CIG BLW")), " "), 1, 3)
    wind = F.concat(F.lit("SUSTAINED SURFACE WIND"), F.substring_index(F.get(F.split(words, "SUSTAINED SURFACE WIND", 2), F.lit(1)), "KT", 1), F.lit("KT"))
    hidden = word(words, "MTNS OBSC BY")
    return (
        F.when(low.isNotNull(), F.concat(F.lit("CIG BLW "), F.array_join(low, " ")))
        .when(hidden.isNotNull(), F.concat(F.lit("MTNS OBSC BY "), hidden))
        .when(words.contains("SUSTAINED SURFACE WIND"), wind)
        .otherwise(out)
    )


def _description(x: Values) -> Column:
    """The condition with the levels of turbulence or ice, and the freezing levels named with them."""
    pair, freezing = x["pair"], word(x["said"], "FRZLVL")
    layer = x["condition"].isin("MOD TURB", "SEV TURB", "MOD ICE", "SEV ICE")
    low, high = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    between = F.concat(F.when(low.isNull(), F.concat(F.lit(" BLW "), high)).otherwise(F.concat(F.lit(" BTN "), low, F.lit(" AND "), high)))
    named = F.get(F.regexp_extract_all(x["said"], F.lit(r" FRZLVL (\d{3}-\d{3}) "), F.lit(1)), F.lit(0))
    return F.when(
        layer, F.concat(x["condition"], F.coalesce(between, F.lit("")), F.coalesce(F.concat(F.lit(". FRZLVL "), named), F.lit("")))
    ).otherwise(x["condition"])


def _area(x: Values) -> list[Column]:
    """The values of a hazard, of wind shear or of an outlook's area."""
    named = F.when(x["kind"] == "SHEAR", "LOW_LEVEL_WIND_SHEAR")
    for written, name in HAZARDS.items():
        named = F.when(x["written"] == written, name).otherwise(named)
    return [
        named.alias("hazardType"),
        F.filter(F.split(F.regexp_replace(x["where"], r"\b(AND|CSTL|WTRS)\b", " "), r"[\s,]+"), lambda s: s.rlike("^[A-Z]{2,3}$")).alias("states"),
        F.coalesce(x["where"].rlike(r"\bCSTL WTRS\b|\bAND CSTL\b"), F.lit(False)).alias("coastalWaters"),
        area_points(x["said"]).alias("areaPoints"),
        _points(x["said"]).alias("boundedBy"),
        altitude_range_of(x["pair"]).alias("altitudes"),
        x["condition"].alias("condition"),
        _description(x).alias("description"),
        sentence(x["text"], "DUE TO").alias("cause"),
        _conditions(x).alias("conditions"),
        x["text"].alias("raw"),
    ]


def _heading(s: Column) -> list[Column]:
    """Of a section: its kind, text and words, the states, the outlook's times, and the hazard and number as written."""
    kinds = "|".join(HAZARDS)
    # the states stand between the stops behind the heading, or an area's kind, and the points
    behind = F.get(F.split(s["text"], r"\.{3} ?", 2), F.lit(1))
    where = F.substring_index(F.substring_index(F.regexp_replace(behind, rf"^(?:{kinds}) ", ""), " FROM ", 1), " BOUNDED BY ", 1)
    return [
        s["kind"].alias("kind"), s["text"].alias("text"), said(s["text"]).alias("said"), where.alias("where"), F.split(s["valid"], "-").alias("window"),
        F.regexp_extract(s["text"], rf"^(?:AIRMET |AREA \d+ ?\.{{3}} ?)({kinds})\b", 1).alias("written"), c.number(F.regexp_extract(s["text"], r"^AREA (\d+)", 1)).alias("number"),
    ]


def _phrases(x: Values) -> list[Column]:
    """What follows CONDS, the two levels, or for a hazard of turbulence that lies below one, nothing and that one, and the weather."""
    top = word(x["said"], "TURB BLW")
    pair = F.coalesce(levels(x["said"]), F.when((x["kind"] == "HAZARD") & altitude_ft(top).isNotNull(), F.array(F.lit(None).cast("string"), top)))
    return [after(x["said"], "CONDS").alias("tail"), pair.alias("pair"), _condition(x["said"]).alias("condition")]


#: Steps by which a section is read; each gives names to the next.
_STEPS = [_heading, _phrases, lambda x: [v.alias(k) for k, v in _spans(x["tail"]).items()], lambda x: [F.struct(*[v.alias(k) for k, v in _times(x).items()]).alias("times")]]


def _owned(s: Column) -> Column:
    """Whether a section is a hazard, a potential of wind shear, or an area of an outlook."""
    return s["kind"].isin("HAZARD", "SHEAR") | ((s["kind"] == "AREA") & s["valid"].isNotNull())


def _with_areas(rows: DataFrame) -> DataFrame:
    """__areas: the hazards, potentials of wind shear and outlook areas among the __sections."""
    given, known = F.filter("__sections", _owned), []
    for n, step in enumerate(_STEPS):
        read = F.transform(given, lambda x: F.struct(*[x[k].alias(k) for k in known], *step(x)))  # noqa: B023
        rows = settled(rows, read.alias(f"__a{n}"))
        given = F.col(f"__a{n}")
        known = rows.schema[f"__a{n}"].dataType.elementType.names

    def area(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["number"].alias("areaNumber"), F.get(x["window"], F.lit(0)).alias("from"), F.get(x["window"], F.lit(1)).alias("to"), F.struct(*_area(x)).alias("values"))

    return settled(rows, F.transform(given, area).alias("__areas")).drop(*[f"__a{n}" for n in range(len(_STEPS))])


def _area_rows(reports: DataFrame, raw: str, kinds: list[str]) -> tuple[DataFrame, list[str]]:
    """One row for each section of the kinds given, in order from 0, its values columns, and their names.

    Sections are rows before they are read, and what nothing uses is not read.
    """
    kept = [x for x in reports.columns if x != raw]
    rows = _with_head(settled(reports, c.squeezed(F.col(raw)).alias("__text")))
    rows = _with_sections(rows, F.col("__text"))
    held = F.filter("__sections", lambda s: _owned(s) & s["kind"].isin(kinds))
    rows = settled(rows, held.alias("__held")).select(*kept, "__head", F.posexplode("__held").alias("pos", "__s"))
    x: dict[str, Column] = {}
    for step in _STEPS:
        made = step(x or F.col("__s"))
        names = rows.select(*made).columns
        rows = settled(rows, *[v.alias(f"__{n}") for n, v in zip(names, made)])
        x |= {n: F.col(f"__{n}") for n in names}
    values = _area(x)
    names = rows.select(*values).columns
    return settled(rows, *[v.alias(n) for n, v in zip(names, values)]), names


def hazards(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per hazard or potential of wind shear of each bulletin: series, updateNumber, pos, and the values that `parse_airmet` lists."""
    kept = [x for x in reports.columns if x != raw]
    rows, names = _area_rows(reports, raw, ["HAZARD", "SHEAR"])
    return rows.select(*kept, c.found(F.col("__head"), _HEAD, 1).alias("series"), c.number(c.found(F.col("__head"), _HEAD, 2)).alias("updateNumber"), "pos", *names)


def outlooks(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per outlook area of each bulletin: pos, areaNumber, validFrom, validTo, and the values that `parse_airmet` lists."""
    kept = [x for x in reports.columns if x != raw]
    rows, names = _area_rows(reports, raw, ["AREA"])
    ends = [c.day_time_of(F.get("__window", F.lit(n))).alias(name) for n, name in enumerate(("validFrom", "validTo"))]
    return rows.select(*kept, "pos", F.col("__number").alias("areaNumber"), *ends, *[n for n in names if n in _OUTLOOK])


def _with_freezing(rows: DataFrame) -> DataFrame:
    """__freezing of the last section of freezing levels: the range over the area, contours, and areas of several levels."""
    lines = r"(?= (?:MULT FRZLVL |(?:SFC|\d{3}) ALG |(?:SFC|\d{3})-\d{3} [NS] OF ))"
    body = F.get(F.split(F.element_at(F.filter("__sections", lambda s: s["kind"] == "FREEZING"), -1)["text"], r"^FRZLVL ?\.{3}", 2), F.lit(1))
    rows = settled(rows, F.transform(F.split(said(F.when(F.size(F.filter("__sections", lambda s: s["kind"] == "FREEZING")) > 0, body)), lines), lambda p: F.trim(p)).alias("__lines"))

    def line(p: Column) -> Column:
        first = F.substring_index(p, " ", 1)
        rest = F.ltrim(F.substring(p, F.length(first) + 1, F.length(p)))
        kind = F.when(p.startswith("MULT FRZLVL "), "MULT").when(rest.startswith("ALG "), F.when(first == "SFC", "SURFACE").otherwise("LEVEL")).when(rest.rlike(r"^[NS] OF \d+[NS] LINE"), "PARALLEL")
        span = F.regexp_extract(p, r"^(?:RANGING FROM )?((?:SFC|\d{3})-\d{3} ACRS AREA)", 1)
        return F.struct(p.alias("said"), F.when(span != "", "RANGE").otherwise(kind).alias("kind"), rest.alias("rest"), F.when(span != "", span).alias("span"), F.split(F.when(span != "", F.substring_index(span, " ", 1)).otherwise(first), "-").alias("ends"))

    rows = settled(rows, F.transform("__lines", line).alias("__lines2"))
    found = F.col("__lines2")

    def of(*kinds: str) -> Column:
        return F.filter(found, lambda x: x["kind"].isin(*kinds))

    def end(x: Column, n: int) -> Column:
        return altitude_ft(F.get(x["ends"], F.lit(n)))

    ranges, parallels = of("RANGE"), of("PARALLEL")
    overall = F.get(ranges, F.lit(0))
    drawn = F.transform(parallels, lambda x: F.struct(end(x, 0).alias("altitudeFt"), x["said"].alias("location")))
    along = F.transform(F.concat(of("SURFACE"), of("LEVEL")), lambda x: F.struct(end(x, 0).alias("altitudeFt"), x["rest"].alias("location")))
    several = F.transform(of("MULT"), lambda x: F.struct(altitude_ft(word(F.concat(F.lit(" "), x["said"]), "FRZLVL BLW")).alias("belowFt"), _points(F.concat(F.lit(" "), x["said"], F.lit(" "))).alias("boundedBy")))
    ranged = F.size(ranges) > 0
    return settled(
        rows,
        F.struct(
            overall["span"].alias("range"),
            F.when(ranged, end(overall, 0)).otherwise(end(F.get(parallels, F.lit(0)), 0)).alias("rangeLowFt"),
            F.when(ranged, end(overall, 1)).otherwise(F.array_max(F.transform(parallels, lambda x: end(x, 1)))).alias("rangeHighFt"),
            F.when(ranged, along).otherwise(F.concat(drawn, along)).alias("contours"),
            several.alias("multiple"),
        ).alias("__freezing"),
    ).drop("__lines", "__lines2")


def parse_airmet(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """The values of each bulletin, empty lists and nulls where it has none; error where its series is none."""
    rest = [x for x in reports.columns if x != raw]
    rows = settled(reports, c.squeezed(F.col(raw)).alias("__text"))
    rows = settled(_with_head(rows), c.found(F.col("__text"), r"\b[A-Z]{3,4} WA \d{6}\b", 0).alias("__office"))
    rows = _with_freezing(_with_areas(_with_sections(rows, F.col("__text"))))
    first, office, areas = F.col("__head"), F.col("__office"), F.col("__areas")

    def texts(kind: str) -> Column:
        return F.transform(F.filter("__sections", lambda s: s["kind"] == kind), lambda s: s["text"])

    def outlook(a: Column) -> Column:
        v = a["values"]
        return F.struct(a["areaNumber"].alias("areaNumber"), c.day_time_of(a["from"]).alias("validFrom"), c.day_time_of(a["to"]).alias("validTo"), *[v[n].alias(n) for n in _OUTLOOK])

    return rows.select(
        *rest,
        F.col("__text").alias("raw"),
        c.found(first, _HEAD, 1).alias("series"),
        c.number(c.found(first, _HEAD, 2)).alias("updateNumber"),
        c.found(first, _HEAD, 3).alias("purposes"),
        F.transform(F.split(c.found(first, _HEAD, 3), r"\s+AND\s+"), lambda p: F.trim(p)).alias("products"),
        c.day_time_of(c.found(first, _HEAD, 4)).alias("validUntil"),
        F.substring_index(office, " ", 1).alias("issuingOffice"),
        c.day_time_of(F.substring_index(office, " ", -1)).alias("issuedAt"),
        F.transform(F.filter(areas, lambda a: a["kind"] != "AREA"), lambda a: a["values"]).alias("hazards"),
        F.transform(texts("NIL"), lambda s: F.rtrim(s, F.lit(". "))).alias("nilStatements"),
        F.when(F.size(texts("FREEZING")) > 0, F.col("__freezing")).alias("freezingLevel"),
        F.transform(F.filter(areas, lambda a: a["kind"] == "AREA"), outlook).alias("outlooks"),
        F.when(~F.coalesce(F.col("__text").rlike(r"\bAIRMET (SIERRA|TANGO|ZULU)\b"), F.lit(False)), F.lit("no AIRMET series")).alias("error"),
    )
