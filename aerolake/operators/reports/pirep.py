"""Pilot reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c

# fixed values: the fields of a pilot report
_FIELDS = ("OV", "TM", "FL", "TP", "SK", "WX", "TA", "WV", "TB", "IC", "RM")


def fields(text: Column) -> Column:
    """Map of the two-letter fields to their text; of a field that repeats the last counts."""
    marked = F.regexp_replace(text, rf"/({'|'.join(_FIELDS)})(?=[\sA-Z0-9]|$)", "\x01$1\x02")
    parts = F.filter(F.split(marked, "\x01"), lambda p: p.contains("\x02"))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("k"), F.trim(F.substring_index(p, "\x02", -1)).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def _point(token: Column) -> Column:
    pattern = r"^([A-Z]{2,5})\s*(\d{3})(\d{3})$"
    polar = token.rlike(pattern)
    return F.struct(
        F.when(polar, F.regexp_extract(token, pattern, 1)).otherwise(token).alias("identifier"),
        c.number(F.regexp_extract(token, pattern, 2)).alias("radialDeg"),
        c.number(F.regexp_extract(token, pattern, 3)).alias("distanceNm"),
    )


def _hundreds(token: Column) -> Column:
    return c.number(F.regexp_extract(token, r"^(?:FL)?(\d{2,3})$", 1)) * 100


def _layers(text: Column, intensities: str, kinds: str) -> Column:
    """Turbulence or icing layers: intensity (or a range), kind, frequency, base and top."""
    grade = rf"\b({intensities})(?:-({intensities}))?\b"
    altitudes = r"\b(?:FL)?(\d{2,3})-(?:FL)?(\d{2,3})\b"

    def layer(t: Column) -> Column:
        return F.struct(
            c.found(t, grade, 1).alias("intensity"),
            c.found(t, grade, 2).alias("intensityHigh"),
            c.found(t, rf"\b({kinds})\b").alias("type"),
            c.found(t, r"\b(OCC|INT|CONT)\b").alias("frequency"),
            F.coalesce(c.number(c.found(t, altitudes, 1)), c.number(c.found(t, r"\bABV\s+(?:FL)?(\d{2,3})\b"))).alias("baseHundreds"),
            F.coalesce(c.number(c.found(t, altitudes, 2)), c.number(c.found(t, r"\bBLO\s+(?:FL)?(\d{2,3})\b"))).alias("topHundreds"),
        )

    parts = F.filter(F.transform(F.split(text, "/"), lambda t: F.trim(t)), lambda t: t != "")
    return F.filter(F.transform(parts, layer), lambda x: x["intensity"].isNotNull())


def _sky(text: Column) -> Column:
    between, plain = r"^(\d{3})(FEW|SCT|BKN|OVC)(\d{3})$", r"^(FEW|SCT|BKN|OVC)(\d{3}|UNKN)(?:-TOP(\d{3}|UNKN))?$"

    def layer(t: Column) -> Column:
        first = t.rlike(between)
        return F.struct(
            F.when(t == "CLR", "CLR").when(first, F.regexp_extract(t, between, 2)).otherwise(F.regexp_extract(t, plain, 1)).alias("coverage"),
            (c.number(F.when(first, F.regexp_extract(t, between, 1)).otherwise(F.regexp_extract(t, plain, 2))) * 100).alias("baseFtMsl"),
            (c.number(F.when(first, F.regexp_extract(t, between, 3)).otherwise(F.regexp_extract(t, plain, 3))) * 100).alias("topFtMsl"),
        )

    parts = F.transform(F.split(text, r"[\s/]+"), lambda t: F.trim(t))
    return F.transform(F.filter(parts, lambda t: (t == "CLR") | t.rlike(between) | t.rlike(plain)), layer)


def _columns(text: Column, f: Column) -> list[Column]:
    """All that a report says, from its text, the map of its fields, and the fields as columns of their own."""
    kind = c.found(text, r"(?:^|\s)(UUA|UA)(?=\s|/|$)")

    def field(name: str) -> Column:
        return F.col(f"__{name}")

    where, level, temperature = field("OV"), field("FL"), field("TA")
    air = r"^(\d{3})(\d{2,3})(?:KT)?$"
    degrees = c.number(F.regexp_extract(temperature, r"^(?:M|-)?(\d+)$", 1))
    point = c.lat_lon(F.when(where.rlike(r"^\d{4}[NS]\d{5}[EW]$"), where))
    seen = c.found(field("WX"), r"(?:^|\s)FV(\d{2})SM(?=\s|$)")
    miles = c.found(field("WX"), rf"(?:^|\s)({c.VISIBILITY})")
    return [
        text.alias("raw"),
        F.coalesce(kind, F.lit("UA")).alias("type"),
        c.found(text, r"^([A-Z0-9]{3,4})\s+UU?A\b").alias("station"),
        F.when(where.isNull(), None).when(point.isNotNull(), "latlon").when(where.contains("-"), "route").otherwise("station").alias("locationType"),
        point.alias("coordinates"),
        F.when(where.isNotNull() & point.isNull(), F.transform(F.split(where, "-"), lambda t: _point(F.trim(t)))).alias("points"),
        c.day_time_of(F.when(field("TM").rlike(r"^\d{4}$"), field("TM"))).alias("time"),
        _hundreds(level).alias("altitudeFtMsl"),
        F.when(level.isin("UNKN", "DURD", "DURC"), level).alias("altitudeQualifier"),
        field("TP").alias("aircraftType"),
        _sky(F.coalesce(field("SK"), F.lit(""))).alias("sky"),
        F.coalesce(seen.try_cast("double"), c.visibility(miles)["visibilitySm"]).alias("visibilitySm"),
        c.weather(F.array_join(F.filter(c.tokens(F.coalesce(field("WX"), F.lit(""))), lambda t: t.rlike(rf"^{c.WEATHER}$")), " ")).alias("weather"),
        F.when(temperature.rlike("^(M|-)"), -degrees).otherwise(degrees).alias("temperatureC"),
        c.number(F.regexp_extract(field("WV"), air, 1)).alias("windDirectionDeg"),
        c.number(F.regexp_extract(field("WV"), air, 2)).alias("windSpeedKt"),
        _layers(F.coalesce(field("TB"), F.lit("")), "NEG|LGT|MOD|SEV|EXTRM", "CAT|CHOP|LLWS").alias("turbulence"),
        _layers(F.coalesce(field("IC"), F.lit("")), "NEG|TR|LGT|MOD|SEV", "RIME|CLR|MXD|SLD").alias("icing"),
        field("RM").alias("remarks"),
        F.when(F.size(f) <= 0, F.lit("no fields")).alias("error"),
    ]


def parse(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """`reports` with the columns of each report; `error` says why one cannot be read."""
    rest = [x for x in reports.columns if x != raw]
    rows = settled(reports, c.squeezed(F.col(raw)).alias("__text"))
    rows = settled(rows, fields(F.coalesce("__text", F.lit(""))).alias("__fields"))
    rows = settled(rows, *[c.some(F.col("__fields")[name]).alias(f"__{name}") for name in _FIELDS])
    values = _columns(F.col("__text"), F.col("__fields"))
    names = rows.select(*values).columns
    rows = settled(rows, *[v.alias(f"__v_{n}") for n, v in zip(names, values)])
    return rows.select(*rest, *[F.col(f"__v_{n}").alias(n) for n in names])
