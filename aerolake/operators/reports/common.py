"""Parts that several kinds of report share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = r"(?=\s|$)"
_CUT = "\x01"

# fixed values: weather codes and their descriptors
PHENOMENA = "DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PY|PO|SQ|FC|SS|DS"
DESCRIPTORS = "MI|PR|BC|DR|BL|SH|TS|FZ"
WIND = rf"(?:VRB|\d{{3}})\d{{2,3}}(?:G\d{{2,3}})?KT{END}"
VISIBILITY = rf"(?:P\d+SM|\d+\s+\d/\d+SM|M?\d+/\d+SM|\d+SM|\d{{4}}){END}"
WEATHER = rf"[+-]?(?:VC)?(?:{PHENOMENA}|{DESCRIPTORS})+{END}"
LAYER = r"(?:FEW|SCT|BKN|OVC)\d{3}"


def number(text: Column) -> Column:
    """A whole number, or null."""
    return text.try_cast("int")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of an anchored pattern as an array, run once; null where it doesn't match."""
    marks = _CUT.join(f"${n}" for n in range(1, count + 1))
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, marks), _CUT, -1))


def some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def day_time(day: Column, hour: Column, minute: Column) -> Column:
    """A partial time: day of month (may be null), hour, minute."""
    when = F.struct(number(day).alias("day"), number(hour).alias("hour"), number(minute).alias("minute"))
    return F.when(hour.isNotNull(), when)


def day_time_of(digits: Column) -> Column:
    """HH, HHMM or DDHHMM, with or without Z."""
    d = F.regexp_replace(digits, "Z$", "")
    zero, none = F.lit("0"), F.lit(None).cast("string")
    return (
        F.when(d.rlike(r"^\d{6}$"), day_time(F.substring(d, 1, 2), F.substring(d, 3, 2), F.substring(d, 5, 2)))
        .when(d.rlike(r"^\d{4}$"), day_time(none, F.substring(d, 1, 2), F.substring(d, 3, 2)))
        .when(d.rlike(r"^\d{2}$"), day_time(none, d, zero))
    )


def wind(token: Column) -> Column:
    """direction (null for calm or variable), variable, calm, speed, gust of a wind token."""
    pattern = r"^(VRB|\d{3})(\d{2,3})(?:G(\d{2,3}))?KT$"
    where, speed = F.regexp_extract(token, pattern, 1), number(F.regexp_extract(token, pattern, 2))
    calm = (where == "000") & (speed == 0)
    fields = F.struct(
        F.when((where != "VRB") & ~calm, number(where)).alias("directionDeg"),
        (where == "VRB").alias("isVariable"),
        calm.alias("isCalm"),
        speed.alias("speedKt"),
        number(F.regexp_extract(token, pattern, 3)).alias("gustKt"),
    )
    return F.when(token.rlike(pattern), fields)


def visibility(text: Column) -> Column:
    """Statute miles or meters, and whether less or more than that."""
    whole = number(F.regexp_extract(text, r"^(\d+)\s+\d/\d+SM$", 1))
    share = r"(\d+)/(\d+)SM$"
    fraction = F.try_divide(F.regexp_extract(text, share, 1).try_cast("double"), F.regexp_extract(text, share, 2).try_cast("double"))
    miles = F.regexp_extract(text, r"^P?(\d+)SM$", 1).try_cast("double")
    fields = F.struct(
        F.when(text.rlike(r"^P?\d+SM$"), miles).when(text.rlike(r"^\d+\s"), whole + fraction).when(text.rlike("/"), fraction).alias("visibilitySm"),
        F.when(text.rlike(r"^\d{4}$"), number(text)).alias("visibilityM"),
        text.startswith("M").alias("isLessThan"),
        text.startswith("P").alias("isMoreThan"),
    )
    return F.when(some(text).isNotNull(), fields)


def phenomenon(token: Column) -> Column:
    """Intensity, vicinity, descriptor and phenomena of a weather token."""
    pattern = rf"^([+-]?)(VC)?({DESCRIPTORS})?((?:{PHENOMENA})*)"
    sign = F.regexp_extract(token, pattern, 1)
    return F.struct(
        token.alias("raw"),
        F.when(sign == "+", "HEAVY").when(sign == "-", "LIGHT").otherwise("MODERATE").alias("intensity"),
        (F.regexp_extract(token, pattern, 2) == "VC").alias("isVicinity"),
        found(token, pattern, 3).alias("descriptor"),
        F.filter(F.split(F.regexp_extract(token, pattern, 4), "(?<=\\G..)"), lambda c: c != "").alias("phenomena"),
    )


def weather(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), phenomenon), lambda w: w["descriptor"].isNotNull() | (F.size(w["phenomena"]) > 0))


def sky(text: Column, cavok: Column, clear: str = "CLR|SKC") -> Column:
    """Clear word, vertical visibility and layers of the sky tokens."""
    parts = tokens(text)
    pattern = rf"^(FEW|SCT|BKN|OVC)(\d{{3}})(CB|TCU)?$"

    def layer(t: Column) -> Column:
        return F.struct(F.regexp_extract(t, pattern, 1).alias("coverage"), (number(F.regexp_extract(t, pattern, 2)) * 100).alias("altitudeFtAgl"), found(t, pattern, 3).alias("type"))

    clears = F.filter(parts, lambda t: t.rlike(f"^({clear})$"))
    vertical = F.filter(parts, lambda t: t.rlike(r"^VV\d{3}$"))
    return F.struct(
        F.when(cavok, F.lit("SKC")).otherwise(F.get(clears, F.size(clears) - 1)).alias("clear"),
        (number(F.substring(F.get(vertical, F.size(vertical) - 1), 3, 3)) * 100).alias("verticalVisibilityFtAgl"),
        F.transform(F.filter(parts, lambda t: t.rlike(pattern)), layer).alias("layers"),
    )


def flight_category(visibility_sm: Column, less_than: Column, sky_: Column, cavok: Column) -> Column:
    """LIFR, IFR, MVFR or VFR: the worse of ceiling and visibility; null where neither is known."""
    ceilings = F.transform(F.filter(sky_["layers"], lambda x: x["coverage"].isin("BKN", "OVC")), lambda x: x["altitudeFtAgl"])
    ceiling = F.least(F.array_min(ceilings), sky_["verticalVisibilityFtAgl"])
    seen = visibility_sm - F.when(less_than, 0.01).otherwise(0.0)
    by_ceiling = F.when(ceiling < 500, 0).when(ceiling < 1000, 1).when(ceiling <= 3000, 2).when(ceiling > 3000, 3)
    by_sight = F.when(seen < 1, 0).when(seen < 3, 1).when(seen <= 5, 2).when(seen > 5, 3)
    rank = F.least(by_ceiling, by_sight)
    return F.when(cavok, "VFR").when(rank == 0, "LIFR").when(rank == 1, "IFR").when(rank == 2, "MVFR").when(rank == 3, "VFR")


def lat_lon(text: Column) -> Column:
    """Degrees of a position written DDMM[NS]DDDMM[EW], white space allowed between."""
    pattern = r"(\d{2})(\d{2})([NS])\s*(\d{3})(\d{2})([EW])"

    def part(n: int) -> Column:
        return F.regexp_extract(text, pattern, n)

    lat = (part(1).try_cast("double") + part(2).try_cast("double") / 60) * F.when(part(3) == "S", -1).otherwise(1)
    lon = (part(4).try_cast("double") + part(5).try_cast("double") / 60) * F.when(part(6) == "W", -1).otherwise(1)
    return F.when(text.rlike(pattern), F.struct(lat.alias("lat"), lon.alias("lon")))
