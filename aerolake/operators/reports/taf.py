"""Terminal forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c

_HEAD = rf"^TAF\s(?:(AMD|COR)\s)?(\S+)\s(\d{{2}})(\d{{2}})(\d{{2}})Z\s(\d{{2}})(\d{{2}})/(\d{{2}})(\d{{2}})(?:\s(.*))?$"
_START = r"(?:FM\d{6}|TEMPO|BECMG|PROB[34]0)"
_PERIOD = r"\d{4}/\d{4}"
_SKY = rf"(?:\s+(?:SKC{c.END}|VV\S*|{c.LAYER}\S*))*"
_GROUP = (
    rf"^(?:FM(\d{{6}}){c.END}|(?:(PROB[34]0){c.END}\s*)?(?:(TEMPO|BECMG){c.END})?(?:\s*({_PERIOD}){c.END})?)"
    rf"(?:\s*({c.WIND}))?(?:\s*(CAVOK){c.END}|(?:\s*({c.VISIBILITY}))?)(?:\s*(NSW){c.END})?((?:\s*{c.WEATHER})*)({_SKY.replace('+(?:SKC', '*(?:SKC')})"
    rf"(?:\s*(WS\d{{3}}/\d{{5,6}}KT){c.END})?(.*)$"
)


def _period(text: Column, at: int) -> Column:
    return c.day_time(F.substring(text, at, 2), F.substring(text, at + 2, 2), F.when(text.isNotNull(), F.lit("0")))


def _layers(text: Column, first: str) -> Column:
    """Turbulence (5) or icing (6) layers: kind, base in hundreds and depth in thousands of feet."""
    found = F.filter(c.tokens(text), lambda t: t.rlike(rf"^{first}\d{{5}}$"))

    def layer(t: Column) -> Column:
        base = c.number(F.substring(t, 3, 3)) * 100
        return F.struct(c.number(F.substring(t, 2, 1)).alias("code"), base.alias("baseFt"), (base + c.number(F.substring(t, 6, 1)) * 1000).alias("topFt"))

    return F.transform(found, layer)


def _values(g: Column) -> list[Column]:
    """The values of a forecast group from the groups of its text."""

    def part(n: int) -> Column:
        return c.some(F.get(g, F.lit(n - 1)))

    cavok = F.coalesce(part(6) == "CAVOK", F.lit(False))
    seen = c.visibility(part(7))
    sky = c.sky(F.coalesce(part(10), F.lit("")), cavok, "SKC")
    shear = r"^WS(\d{3})/(\d{3})(\d{2,3})KT$"
    fm = part(1)
    return [
        F.when(fm.isNotNull(), "FM").otherwise(part(3)).alias("changeType"),
        c.number(F.substring(part(2), 5, 2)).alias("probability"),
        F.coalesce(c.day_time(F.substring(fm, 1, 2), F.substring(fm, 3, 2), F.substring(fm, 5, 2)), _period(part(4), 1)).alias("start"),
        _period(part(4), 6).alias("end"),
        c.wind(part(5)).alias("wind"),
        cavok.alias("isCavok"),
        seen.alias("visibility"),
        part(8).isNotNull().alias("isNoSignificantWeather"),
        c.weather(F.coalesce(part(9), F.lit(""))).alias("weather"),
        sky.alias("sky"),
        F.when(
            part(11).isNotNull(),
            F.struct(
                (c.number(F.regexp_extract(part(11), shear, 1)) * 100).alias("altitudeFtAgl"),
                c.number(F.regexp_extract(part(11), shear, 2)).alias("directionDeg"),
                c.number(F.regexp_extract(part(11), shear, 3)).alias("speedKt"),
            ),
        ).alias("windShear"),
        _layers(F.coalesce(part(12), F.lit("")), "5").alias("turbulence"),
        _layers(F.coalesce(part(12), F.lit("")), "6").alias("icing"),
    ]


def _category(x: Column | dict[str, Column]) -> Column:
    seen = x["visibility"]
    return c.flight_category(seen["visibilitySm"], F.coalesce(seen["isLessThan"], F.lit(False)), x["sky"], x["isCavok"])


def _with_texts(reports: DataFrame, raw: str) -> DataFrame:
    """`reports` with __text, the groups __g of its head, __cancelled, and __texts of its forecast groups."""
    rows = settled(reports, c.squeezed(F.col(raw)).alias("__text"))
    rows = settled(rows, c.groups(F.col("__text"), _HEAD, 10).alias("__g"))
    body = F.coalesce(c.some(F.get("__g", F.lit(9))), F.lit(""))
    # a group begins at each change word, but TEMPO right after a probability belongs to it
    cut = F.regexp_replace(body, rf"\s({_START}){c.END}", "\x01$1")
    cut = F.regexp_replace(cut, r"(^|\x01)(PROB[34]0)\x01TEMPO", "$1$2 TEMPO")
    rows = settled(rows, body.rlike(r"^CNL(\s|$)").alias("__cancelled"))
    texts = F.when(F.col("__cancelled") | F.col("__g").isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.split(cut, "\x01"), lambda t: t != ""))
    return settled(rows, texts.alias("__texts"))


def parse(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """`reports` with the columns of each forecast; `error` says why one cannot be read.

    Each step's results are columns of the next: an expression that is looked at twice runs once.
    """
    kept = [x for x in reports.columns if x != raw]
    rows = settled(_with_texts(reports, raw), F.transform("__texts", lambda t: c.groups(t, _GROUP, 12)).alias("__groups"))
    rows = settled(rows, F.transform("__groups", lambda g: F.struct(*_values(g))).alias("__forecast"))
    rows = settled(rows, F.transform("__forecast", lambda x: x.withField("flightCategory", _category(x))).alias("__rated"))

    def part(n: int) -> Column:
        return c.some(F.get("__g", F.lit(n - 1)))

    minute = F.lit("0")
    return rows.select(
        *kept,
        F.col("__text").alias("raw"),
        part(2).alias("stationId"),
        c.day_time(part(3), part(4), part(5)).alias("issuedAt"),
        F.coalesce(part(1) == "AMD", F.lit(False)).alias("isAmended"),
        F.coalesce(part(1) == "COR", F.lit(False)).alias("isCorrected"),
        F.col("__cancelled").alias("isCancelled"),
        c.day_time(part(6), part(7), minute).alias("validFrom"),
        c.day_time(part(8), part(9), minute).alias("validTo"),
        F.col("__rated").alias("forecast"),
        F.when(F.col("__g").isNull(), F.lit("no TAF header with issue time and validity")).alias("error"),
    )


def groups(parsed: DataFrame) -> DataFrame:
    """One row per forecast group, with its position."""
    return parsed.select("stationId", F.posexplode("forecast").alias("pos", "g")).select("stationId", "pos", "g.*")


def forecasts(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per forecast group of each report, with its position from 0 and its values, as `parse` lists them.

    Groups are rows before they are read, and values that nothing uses are not read.
    """
    kept = [x for x in reports.columns if x != raw]
    rows = _with_texts(reports, raw).select(*kept, F.posexplode("__texts").alias("pos", "__said"))
    rows = settled(rows, c.groups(F.col("__said"), _GROUP, 12).alias("__parts"))
    values = _values(F.col("__parts"))
    names = rows.select(*values).columns
    rows = settled(rows, *values).drop("__said", "__parts")
    return settled(rows, _category({n: F.col(n) for n in names}).alias("flightCategory"))
