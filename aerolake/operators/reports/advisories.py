"""Significant weather: convective, domestic and international SIGMETs; AIRMETs are read in `airmet`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c
from . import international
from .airmet import parse_airmet  # noqa: F401
from .phrases import after, altitude_range_of, area_points, before, intensity_change, levels, moved, movement, movement_of, said, says, sentence, top_words, tops, word

_CONVECTIVE = r"CONVECTIVE SIGMET\s+(\d+)([ECW])\b"
_DOMESTIC = r"\bSIGMET\s+([A-Z0-9]+)\s+(\d+)\s+VALID\s+(?:UNTIL\s+)?(\d{6})(?:/(\d{6}))?"


def _states(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\b(AND|CSTL|WTRS)\b", " "), r"[\s,]+"), lambda s: s.rlike("^[A-Z]{2}$"))


def hail_inches(text: Column) -> Column:
    """Decimal, whole and fraction, or fraction."""
    whole = c.found(text, r"^(\d+(?:\.\d+)?)(?:\s|$)").try_cast("double")
    share = F.try_divide(F.regexp_extract(text, r"(\d+)/(\d+)$", 1).try_cast("double"), F.regexp_extract(text, r"(\d+)/(\d+)$", 2).try_cast("double"))
    return F.when(whole.isNull() & share.isNull(), None).otherwise(F.coalesce(whole, F.lit(0.0)) + F.coalesce(share, F.lit(0.0)))


def split_bulletin(bulletins: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per advisory of a bulletin; convective ones part at each CONVECTIVE SIGMET and share the outlook."""
    text = c.squeezed(F.col(raw))
    outlook = c.found(text, r"(\bOUTLOOK VALID.*)$")
    body = F.regexp_replace(text, r"\s*\bOUTLOOK VALID.*$", "")
    pieces = F.filter(F.split(body, r"(?=\bCONVECTIVE SIGMET\s+\d+[ECW]\b)"), lambda p: p.rlike(_CONVECTIVE))
    several = F.transform(pieces, lambda p: F.concat_ws(" ", F.trim(p), outlook))
    each = F.when(F.size(pieces) > 0, several).otherwise(F.array(text))
    rest = [x for x in bulletins.columns if x != raw]
    return bulletins.select(*rest, F.posexplode(each).alias("item", raw))


def _with_others(rows: DataFrame, prefix: str, foreign: Column, shared: list[str]) -> DataFrame:
    """`rows` of __text and __words with a column, named with the prefix, for each value of convective and domestic advisories.

    Those that no format is needed for are among them; the shared ones, which another reader gives too, are left
    null where the advisory is foreign. The phrases that hold a value are a step, the values the next.
    """
    text, words = F.col("__text"), F.col("__words")
    ash, expected = after(words, "OBS AT"), F.coalesce(after(words, "FCST AT"), after(words, "FCST"))
    parts = {
        "__convective": text.contains("CONVECTIVE SIGMET"),
        "__storm": F.concat(F.substring_index(words, " TS ", 1), F.lit(" ")),
        "__until": c.found(text, r"VALID UNTIL\s+(\d{4,6})Z?"),
        **{f"__d{n}": c.found(text, _DOMESTIC, n) for n in range(1, 5)},
        "__eruption_of": after(words, "ERUPTION OF"),
        "__pair": levels(words),
        "__behind_top": top_words(words),
        "__moving": moved(text),
        "__beyond": word(words, "CONDS CONTG BYD"),
        "__by": word(words, "CONDS ENDG BY"),
        "__outlook": F.split(word(words, "OUTLOOK VALID"), "-"),
        "__hail": F.trim(F.element_at(F.split(after(words, "HAIL TO"), " ?IN "), 1)),
        "__ash": F.when(says(words, "VOLCANIC ASH", "VA CLD"), F.slice(F.split(F.ltrim(ash), " "), 1, 2)),
        "__expected_ash": F.when(says(words, "VOLCANIC ASH", "VA CLD"), F.slice(F.split(F.ltrim(expected), " "), 1, 2)),
    }
    own = {"__until", "__d1", "__d2", "__d3", "__d4", "__eruption_of", "__pair", "__moving", "__expected_ash"}  # what only shared values need
    rows = settled(rows, *[(F.when(~foreign, v) if k in own else v).alias(k) for k, v in parts.items()])

    def behind(tail: str) -> Column:
        """The levels that stand behind a time."""
        level = F.concat(F.lit(" "), F.get(F.col(tail), F.lit(1)), F.lit(" "))
        return F.when(F.get(F.col(tail), F.lit(0)).rlike("^[0-9]{4}Z$"), levels(level))

    volcano = r"\d{4}[NS]\d{5}[EW]"
    rows = settled(rows, behind("__ash").alias("__ash_pair"), behind("__expected_ash").alias("__expected_pair"), c.found(F.col("__eruption_of"), volcano, 0).alias("__volcano"))
    convective, storm = F.col("__convective"), F.col("__storm")
    hazards = F.array_compact(
        F.array(
            F.when(says(words, "SEV TURB"), "TURBULENCE"),
            F.when(says(words, "SEV ICE"), "ICING"),
            F.when(says(words, "SEV DUST/SANDSTORM"), "DUST_SANDSTORM"),
            F.when(says(words, "VOLCANIC ASH", "VA CLD", "VA ERUPTION"), "VOLCANIC_ASH"),
        )
    )
    values = {
        "format": F.when(convective, "CONVECTIVE").when(text.rlike(r"\bSIGMET\b"), "NON_CONVECTIVE"),
        "number": F.when(convective, c.number(c.found(text, _CONVECTIVE, 1))).otherwise(c.number(F.col("__d2"))),
        "region": F.when(convective, F.coalesce(c.found(text, _CONVECTIVE, 2), c.found(text, r"SIG([ECW])\b"))),
        "seriesName": F.when(~convective, F.coalesce("__d1", c.found(text, r"CANCEL SIGMET\s+([A-Z0-9]+)"))),
        "validFrom": c.day_time_of(F.when(F.col("__d4").isNotNull(), F.col("__d3"))),
        "validTo": c.day_time_of(F.coalesce("__d4", "__until")),
        "isCancellation": says(words, "CANCEL SIGMET", "CNL SIGMET"),
        "isNone": F.coalesce(text.contains("CONVECTIVE SIGMET...NONE"), F.lit(False)),
        "states": _states(F.coalesce(c.found(text, r"(?:\d{4}Z?\s+|^)((?:[A-Z]{2}\s+)+(?:AND\s+)?(?:[A-Z]{2}\s+)*(?:CSTL\s+WTRS\s+)?)FROM\b"), F.lit(""))),
        "coastalWaters": says(words, "CSTL WTRS"),
        "areaPoints": area_points(words),
        "thunderstormType": F.when(says(words, "TS"), F.when(storm.contains(" AREA "), "AREA").when(storm.contains(" LINE "), "LINE").when(storm.contains(" ISOL "), "ISOLATED")),
        "isSevere": says(words, "SEV TS", "SEV EMBD TS"),
        "isEmbedded": says(words, "EMBD"),
        "lineWidthNm": F.when(says(words, "NM WIDE"), c.number(F.substring_index(before(words, "NM WIDE"), " ", -1))),
        "tops": tops(F.col("__behind_top")),
        "hasTornadoes": says(words, "TORNADO", "TORNADOS", "TORNADOES"),
        "hailSizeIn": hail_inches(F.col("__hail")),
        "windGustsKt": c.number(F.rtrim(F.coalesce(word(words, "WIND GUSTS TO"), word(words, "WIND GUST TO")), F.lit("KT"))),
        "hazards": hazards,
        "isOccasional": says(words, "OCNL SEV"),
        "altitudes": altitude_range_of(F.col("__pair")),
        "cause": sentence(text, "DUE TO"),
        "visibilityBelowSm": c.number(F.rtrim(word(words, "VIS BLW"), F.lit("SM"))),
        "movement": movement_of(F.col("__moving")),
        "intensityChange": intensity_change(words),
        "volcanoName": F.when(F.col("__volcano").isNotNull(), F.trim(F.get(F.split("__eruption_of", volcano, 2), F.lit(0)))),
        "volcanoPosition": c.lat_lon(F.col("__volcano")),
        "ashCloudAltitudes": altitude_range_of(F.col("__ash_pair")),
        "forecastTime": F.when(F.col("__expected_pair").isNotNull(), c.day_time_of(F.get("__expected_ash", F.lit(0)))),
        "forecastAltitudes": altitude_range_of(F.col("__expected_pair")),
        "continuingBeyond": c.day_time_of(F.col("__beyond")),
        "endingBy": c.day_time_of(F.col("__by")),
        "outlook": F.when(F.col("__outlook").isNotNull(), F.struct(c.day_time_of(F.get("__outlook", F.lit(0))).alias("validFrom"), c.day_time_of(F.get("__outlook", F.lit(1))).alias("validTo"))),
    }
    return settled(rows, *[(F.when(~foreign, v) if k in shared else v).alias(f"{prefix}{k}") for k, v in values.items()])


#: Columns of `parse_sigmet`; those of the second line come from either reader, those of the last from the international one alone.
_SIGMET = """region isNone states coastalWaters areaPoints thunderstormType isSevere isEmbedded lineWidthNm hasTornadoes hailSizeIn windGustsKt hazards isOccasional cause visibilityBelowSm ashCloudAltitudes continuingBeyond endingBy outlook
seriesName number validFrom validTo isCancellation altitudes movement intensityChange volcanoName volcanoPosition forecastTime forecastAltitudes
issuingStation firCode firName cancelled phenomena observationStatus observedAt areaDescription areaRing isEntireRegion isStationary cycloneName cyclonePosition cbTopFl withinNm forecastPosition forecastArea additionalInfo"""


def parse_sigmet(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """The values of each advisory of any format, null where its format has none; error where the text is none.

    Text, words, clauses and each reader's values are steps of their own, evaluated once for a row.
    """
    rest = [x for x in reports.columns if x != raw]
    rows = international.with_clauses(settled(reports, c.squeezed(F.col(raw)).alias("__text")), "__text")
    rows = settled(rows, F.coalesce(F.col("__content"), said(F.col("__text"))).alias("__words"))
    one, both, own = (line.split() for line in _SIGMET.split("\n"))
    abroad = F.col("__head").isNotNull()
    rows = international.with_fields(_with_others(rows, "__o_", abroad, both), "__i_")
    tops_ = F.col("__o_tops")
    return rows.select(
        *rest,
        F.col("__text").alias("raw"),
        F.when(abroad, "INTERNATIONAL").otherwise(F.col("__o_format")).alias("format"),
        *[F.coalesce(f"__i_{x}", f"__o_{x}").alias(x) for x in both],
        *[F.col(f"__o_{x}").alias(x) for x in one],
        *[F.col(f"__i_{x}").alias(x) for x in own],
        tops_["altitudeFt"].alias("topsFt"),
        F.coalesce(tops_["isAbove"], F.lit(False)).alias("topsAbove"),
        F.when(~abroad & F.col("__o_format").isNull(), F.lit("no SIGMET")).alias("error"),
    )
