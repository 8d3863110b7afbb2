"""The plain-language groups of an observation's remarks, clause by clause.

A remarks section is cut before every word that opens a group, once; each kind of group then reads
its own clauses, from their beginning, and leaves the words beyond its grammar alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common as c

# Cloud types, cover, obscuring weather, sensors, and weather whose begin and end are told.
_CLOUDS = "CBMAM|CB|TCU|ACC|ACSL|CCSL|SCSL"
_COVER = "FEW|SCT|BKN|OVC"
_OBSCURING = "FG|FU|HZ|BR|DU|SA|VA|PY"
_SENSORS = "TSNO|PWINO|FZRANO|PNO|RVRNO"
_TIMED = "TSRA|TSSN|FZRA|FZDZ|SHSN|SHRA|RA|SN|PL|DZ|GR|GS|IC|SG|UP|TS|FG|BR|HZ|FU|VA|DU|SA"

_OFTEN = "FRQ|OCNL|CONS"
_DIRECTION = r"(?:[NSEW]{1,2}(?:-[NSEW]{1,2})?|OHD)"
_RUNWAY = r"RWY\d{2}[LCR]?"
_MILES = r"\d+ \d/\d+|\d+/\d+|\d+"
_ONE = r"\d+(?:/\d+)?"
_OPENING = (
    rf"(?:TS|VIRGA|{_CLOUDS}|(?:TWR |SFC )?VIS|CIG|GR|SNINCR|VISNO|CHINO|(?:(?:{_OFTEN}) )?LTG[^ ]*"
    rf"|(?:{_COVER})\d{{3}} V (?:{_COVER})|(?:{_OBSCURING}) (?:{_COVER})\d{{3}})(?= |$)"
)
_CUT = "\x01"


def clauses(text: Column) -> Column:
    """The remarks cut before every word that opens a group; a word that belongs before an opening one stays with it."""
    within = "".join(f"(?<!{word})" for word in ("TWR", "SFC", *_OFTEN.split("|")))
    return F.split(F.regexp_replace(c.squeezed(text), rf"{within} (?={_OPENING})", _CUT), _CUT)


def _miles(text: Column) -> Column:
    """Statute miles or inches of a whole number, a fraction, or both."""
    whole = F.regexp_extract(text, r"^(\d+)(?: |$)", 1).try_cast("double")
    above, below = (F.regexp_extract(text, r"(\d+)/(\d+)$", n).try_cast("double") for n in (1, 2))
    return F.when(whole.isNotNull() | below.isNotNull(), F.coalesce(whole, F.lit(0.0)) + F.coalesce(above / below, F.lit(0.0)))


def _words(*allowed: str, most: str = "*") -> str:
    """Pattern of a group of further words, each of the allowed ones."""
    return rf"((?: (?:{'|'.join(allowed)})(?= |$)){most})"


def _place(text: Column) -> Column:
    return c.some(F.trim(text))


def _moment(digits: Column, hour: Column) -> tuple[Column, Column]:
    """Hour and minute of HHMM, or of MM in the observation's hour."""
    full = F.length(digits) == 4
    return F.when(full, c.number(F.substring(digits, 1, 2))).otherwise(hour).alias("hour"), c.number(F.when(full, F.substring(digits, 3, 2)).otherwise(digits)).alias("minute")


def details(cut: Column, hour: Column) -> list[Column]:
    """The groups of `clauses`, each a column: lists in the order of the text, of single groups the last; null or empty where there is none."""

    def each(pattern: str, build: Callable[..., Column]) -> Column:
        """The clauses that begin as the pattern says, of which `build` takes the groups."""
        whole = rf"^{pattern}(?= |$)"
        return F.transform(F.filter(cut, lambda x: x.rlike(whole)), lambda x: build(lambda n: F.regexp_extract(x, whole, n)))

    def last(values: Column) -> Column:
        return F.try_element_at(values, F.lit(-1))

    def feet(hundreds: Column) -> Column:
        return c.number(hundreds) * 100

    spot, near = (_DIRECTION, "DSNT", "VC", "AND"), (_DIRECTION, "DSNT", "VC", "MOV")
    text = F.array_join(cut, " ")
    missing = rf"(?:(?<= )|^)(?:{_SENSORS}|(?:VISNO|CHINO)(?: {_RUNWAY})?)(?= |$)"
    timed = rf"(?:(?<= )|^)(?:{_TIMED})(?:[BE]\d{{2,4}})+(?= |$)"

    def lightning(g: Callable[[int], Column]) -> Column:
        kinds = F.filter(F.regexp_extract_all(g(2), F.lit(".."), F.lit(0)), lambda k: k.isin("IC", "CC", "CG", "CA"))
        return F.struct(c.some(g(1)).alias("frequency"), kinds.alias("types"), _place(g(3)).alias("location"))

    def events(word: Column) -> Column:
        phenomenon = F.regexp_extract(word, rf"^({_TIMED})[BE]\d", 1)
        steps = F.regexp_extract_all(F.substring(word, F.length(phenomenon) + 1, F.length(word)), F.lit(r"[BE]\d{2,4}"), F.lit(0))
        return F.transform(steps, lambda s: F.struct(phenomenon.alias("phenomenon"), F.when(s.startswith("B"), "BEGIN").otherwise("END").alias("eventType"), *_moment(F.substring(s, 2, 4), hour)))

    storms = F.filter(cut, lambda x, i: x.rlike("^TS(?: |$)") & ((x != "TS") | (i < F.size(cut) - 1)))
    storm = rf"^TS{_words(*spot)}(?: MOV(?: ([^ ]+))?)?"
    return [
        each(rf"(TWR|SFC) VIS ({_MILES})", lambda g: F.struct(g(1).alias("source"), _miles(g(2)).alias("visibilitySm"))).alias("towerSurfaceVisibility"),
        last(each(rf"VIS ({_ONE})V({_ONE})", lambda g: F.struct(_miles(g(1)).alias("minVisibilitySm"), _miles(g(2)).alias("maxVisibilitySm")))).alias("variableVisibility"),
        each(rf"VIS ([NSEW]{{1,2}})({_ONE})", lambda g: F.struct(g(1).alias("direction"), _miles(g(2)).alias("visibilitySm"))).alias("sectorVisibility"),
        each(rf"VIS ({_MILES}) ({_RUNWAY})", lambda g: F.struct(_miles(g(1)).alias("visibilitySm"), g(2).alias("location"))).alias("secondLocationVisibility"),
        each(rf"CIG (\d{{3}}) ({_RUNWAY})", lambda g: F.struct(feet(g(1)).alias("ceilingFtAgl"), g(2).alias("location"))).alias("secondLocationCeiling"),
        last(each(rf"GR (?:LESS THAN )?({_MILES})", lambda g: _miles(g(1)))).alias("hailSizeIn"),
        last(each(r"SNINCR (\d+)/(\d+)", lambda g: F.struct(c.number(g(1)).alias("lastHourIn"), c.number(g(2)).alias("totalDepthIn")))).alias("snowIncreasing"),
        each(rf"(?:({_OFTEN}) )?LTG([^ ]*){_words(*spot)}", lightning).alias("lightning"),
        F.transform(storms, lambda x: F.struct(_place(F.regexp_extract(x, storm, 1)).alias("location"), c.some(F.regexp_extract(x, storm, 2)).alias("movingDirection"))).alias("thunderstorms"),
        each(rf"VIRGA{_words(_DIRECTION, most='?')}", lambda g: F.struct(_place(g(1)).alias("direction"))).alias("virga"),
        each(rf"({_COVER})(\d{{3}}) V ({_COVER})", lambda g: F.struct(g(1).alias("coverageLow"), g(3).alias("coverageHigh"), feet(g(2)).alias("altitudeFtAgl"))).alias("variableSkyCondition"),
        each(rf"({_CLOUDS}){_words(*near)}", lambda g: F.struct(g(1).alias("type"), _place(g(2)).alias("location"))).alias("significantClouds"),
        each(rf"({_OBSCURING}) ({_COVER})(\d{{3}})", lambda g: F.struct(g(1).alias("phenomenon"), g(2).alias("coverage"), feet(g(3)).alias("altitudeFtAgl"))).alias("obscurations"),
        F.regexp_extract_all(text, F.lit(missing), F.lit(0)).alias("missingData"),
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(timed), F.lit(0)), events)).alias("precipitationEvents"),
    ]
