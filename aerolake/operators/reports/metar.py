"""Surface observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c
from . import remarks as groups

_RVR = r"(?:\s+R\d{2}[LCR]?/\S*)*"
_WX = rf"(?:\s+{c.WEATHER})*"
_SKY = rf"(?:\s+(?:(?:CLR|SKC){c.END}|VV\S*|{c.LAYER}\S*))*"
_BODY = (
    rf"^(?:(METAR|SPECI)\s+)?(\S+)\s+(\d{{2}})(\d{{2}})(\d{{2}})Z{c.END}(?:\s+(AUTO|COR){c.END})?"
    rf"(?:\s+({c.WIND})(?:\s+(\d{{3}}V\d{{3}}){c.END})?)?"
    rf"(?:\s+(CAVOK){c.END}({_RVR})({_WX})|(?:\s+({c.VISIBILITY}))?({_RVR})({_WX})({_SKY}))"
    rf"(?:\s+(M?\d{{2}}/M?\d{{2}}){c.END})?(?:\s+([AQ]\d{{4}}){c.END})?(.*)$"
)
_GROUPS = 18


def _rvr(token: Column) -> Column:
    pattern = r"^R(\d{2}[LCR]?)/([MP]?)(\d{4})(?:V([MP]?)(\d{4}))?FT([UDN])?$"

    def part(n: int) -> Column:
        return F.regexp_extract(token, pattern, n)

    farthest = c.number(part(5))
    return F.struct(
        part(1).alias("runway"),
        c.number(part(3)).alias("visibilityFt"),
        (part(2) == "P").alias("isMoreThan"),
        (part(2) == "M").alias("isLessThan"),
        farthest.alias("variableMaxFt"),
        F.when(farthest.isNotNull(), part(4) == "P").alias("isVariableMaxMoreThan"),
        F.when(part(6) == "U", "RISING").when(part(6) == "D", "FALLING").when(part(6) == "N", "NO_CHANGE").alias("trend"),
    )


def _celsius(text: Column) -> Column:
    value = c.number(F.regexp_replace(text, "^M", ""))
    return F.when(text.startswith("M"), -value).otherwise(value)


def _signed_tenths(text: Column) -> Column:
    """A sign digit (1: below zero) and tenths."""
    value = F.substring(text, 2, 3).try_cast("double") / 10
    return F.when(F.substring(text, 1, 1) == "1", -value).otherwise(value)


def remarks(text: Column, t: Column, hour: Column, cut: Column) -> list[Column]:
    """The groups of a remarks section, coded ones and those of its clauses; groups that are missing are null. t is the text between blanks."""

    def code(pattern: str, group: int = 1) -> Column:
        return c.found(t, rf"\s{pattern}(?=\s)", group)

    def inches(pattern: str) -> Column:
        return code(pattern).try_cast("double") / 100

    pressure = code(r"SLP(\d{3})").try_cast("double")
    peak = r"PK\s+WND\s+(\d{3})(\d{2,3})/(\d{2})?(\d{2})"
    shift = r"WSHFT\s+(\d{2})?(\d{2})(\s+FROPA)?"
    peak_hour = F.coalesce(c.number(code(peak, 3)), hour)
    return [
        text.alias("raw"),
        code(r"(AO[12])").alias("stationType"),
        F.when(pressure >= 500, 900 + pressure / 10).otherwise(1000 + pressure / 10).alias("seaLevelPressureHpa"),
        _signed_tenths(code(r"T([01]\d{3})[01]\d{3}")).alias("preciseTemperatureC"),
        _signed_tenths(code(r"T[01]\d{3}([01]\d{3})")).alias("preciseDewpointC"),
        inches(r"P(\d{4})").alias("hourlyPrecipitationIn"),
        inches(r"6(\d{4})").alias("sixHourPrecipitationIn"),
        inches(r"7(\d{4})").alias("twentyFourHourPrecipitationIn"),
        c.number(code(r"4/(\d{3})")).alias("snowDepthIn"),
        _signed_tenths(code(r"1([01]\d{3})")).alias("sixHourMaxTemperatureC"),
        _signed_tenths(code(r"2([01]\d{3})")).alias("sixHourMinTemperatureC"),
        _signed_tenths(code(r"4([01]\d{3})[01]\d{3}")).alias("twentyFourHourMaxTemperatureC"),
        _signed_tenths(code(r"4[01]\d{3}([01]\d{3})")).alias("twentyFourHourMinTemperatureC"),
        c.number(code(r"5(\d)\d{3}")).alias("pressureTendencyCharacter"),
        (code(r"5\d(\d{3})").try_cast("double") / 10).alias("pressureTendencyHpa"),
        inches(r"I1(\d{3})").alias("iceAccretionOneHourIn"),
        inches(r"I3(\d{3})").alias("iceAccretionThreeHourIn"),
        inches(r"I6(\d{3})").alias("iceAccretionSixHourIn"),
        (code(r"933(\d{3})").try_cast("double") / 10).alias("waterEquivalentIn"),
        F.when(code(peak, 1).isNotNull(), F.struct(c.number(code(peak, 1)).alias("directionDeg"), c.number(code(peak, 2)).alias("speedKt"), peak_hour.alias("hour"), c.number(code(peak, 4)).alias("minute"))).alias("peakWind"),
        F.when(code(shift, 2).isNotNull(), F.struct(F.coalesce(c.number(code(shift, 1)), hour).alias("hour"), c.number(code(shift, 2)).alias("minute"), code(shift, 3).isNotNull().alias("isFrontalPassage"))).alias("windShift"),
        F.when(code("(PRESRR)").isNotNull(), "RISING_RAPIDLY").when(code("(PRESFR)").isNotNull(), "FALLING_RAPIDLY").alias("pressureChange"),
        (c.number(code(r"CIG\s+(\d{3})V\d{3}")) * 100).alias("variableCeilingMinFt"),
        (c.number(code(r"CIG\s+\d{3}V(\d{3})")) * 100).alias("variableCeilingMaxFt"),
        t.rlike(r"\sVIRGA\s").alias("isVirga"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(r"\s(RVRNO|PWINO|PNO|FZRANO|TSNO|VISNO|CHINO|SLPNO)(?=\s)"), F.lit(1))).alias("sensorStatus"),
        t.rlike(r"\s\$\s").alias("isMaintenanceNeeded"),
        *groups.details(cut, hour),
    ]


def _fields(text: Column, g: Column, rest: Column, spaced: Column, cut: Column) -> list[Column]:
    """All that an observation says, from the groups of its body and its remarks."""

    def part(n: int) -> Column:
        return c.some(F.get(g, F.lit(n - 1)))

    cavok = F.coalesce(part(9) == "CAVOK", F.lit(False))
    altimeter = part(17)
    value = F.substring(altimeter, 2, 4).try_cast("double")
    return [
        text.alias("raw"),
        F.coalesce(part(1), F.lit("METAR")).alias("type"),
        part(2).alias("stationId"),
        c.day_time(part(3), part(4), part(5)).alias("observationTime"),
        F.coalesce(part(6) == "AUTO", F.lit(False)).alias("isAutomated"),
        F.coalesce(part(6) == "COR", F.lit(False)).alias("isCorrected"),
        c.wind(part(7)).alias("wind"),
        c.number(F.substring(part(8), 1, 3)).alias("windVariableFromDeg"),
        c.number(F.substring(part(8), 5, 3)).alias("windVariableToDeg"),
        cavok.alias("isCavok"),
        c.visibility(part(12)).alias("visibility"),
        F.transform(F.filter(c.tokens(F.coalesce(part(10), part(13), F.lit(""))), lambda t: t.rlike(r"^R(\d{2}[LCR]?)/([MP]?)(\d{4})(V[MP]?\d{4})?FT[UDN]?$")), _rvr).alias("rvr"),
        c.weather(F.coalesce(part(11), part(14), F.lit(""))).alias("weather"),
        c.sky(F.coalesce(part(15), F.lit("")), cavok).alias("sky"),
        _celsius(F.substring_index(part(16), "/", 1)).alias("temperatureC"),
        _celsius(F.substring_index(part(16), "/", -1)).alias("dewpointC"),
        F.when(altimeter.startswith("A"), value / 100).alias("altimeterInHg"),
        F.when(altimeter.startswith("Q"), value).alias("altimeterHpa"),
        F.coalesce(part(18).rlike(r"(^|\s)NOSIG(\s|$)"), F.lit(False)).alias("isNoSignificantChange"),
        F.when(rest.isNotNull(), F.struct(*remarks(rest, spaced, c.number(part(4)), cut))).alias("remarks"),
    ]


def _with_parts(reports: DataFrame, raw: str) -> DataFrame:
    """`reports` with __text, its __halves, the groups __g of the body, and the remarks' text between blanks and clauses."""
    rows = settled(reports, F.trim(raw).alias("__text"))
    rows = settled(rows, F.split("__text", r"\sRMK\s", 2).alias("__halves"))
    body, rest = F.get("__halves", F.lit(0)), F.get("__halves", F.lit(1))
    return settled(rows, c.groups(body, _BODY, _GROUPS).alias("__g"), F.concat(F.lit(" "), rest, F.lit(" ")).alias("__spaced"), groups.clauses(rest).alias("__cut"))


def parse(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """`reports` with the columns of each observation; `error` says why one cannot be read.

    Each step's results are columns of the next: an expression that is looked at twice runs once.
    """
    kept = [x for x in reports.columns if x != raw]
    rows = _with_parts(reports, raw)
    rows = rows.select(*kept, "__g", *_fields(F.col("__text"), F.col("__g"), F.get("__halves", F.lit(1)), F.col("__spaced"), F.col("__cut")))
    category = c.flight_category(F.col("visibility.visibilitySm"), F.coalesce("visibility.isLessThan", F.lit(False)), F.col("sky"), F.col("isCavok"))
    error = F.when(F.col("__g").isNull(), F.lit("no station and observation time"))
    return rows.withColumn("flightCategory", category).withColumn("error", error).drop("__g")


def parse_remarks(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """`reports` with the fields of `remarks` as columns of their own, null without remarks; those that nothing uses are not read."""
    kept = [x for x in reports.columns if x != raw]
    rows = _with_parts(reports, raw)
    rest = F.get("__halves", F.lit(1))
    values = remarks(rest, F.col("__spaced"), c.number(c.some(F.get("__g", F.lit(3)))), F.col("__cut"))
    names = rows.select(*values).columns
    made = settled(rows.select(*kept, "__halves", "__g", "__spaced", "__cut"), *[F.when(rest.isNotNull(), v).alias(n) for n, v in zip(names, values)])
    return made.select(*kept, *names)
