"""Words and phrases of advisories, and the values that all kinds of them share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import common as c


def said(text: Column) -> Column:
    """The words of a text, one blank between them and at either end, without stops and message ends behind them."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,=]+(?=\s|$)|\.{2,}", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(" "))


def says(words: Column, *phrases: str) -> Column:
    """Whether any of the phrases is there, in whole words."""
    out = F.lit(False)
    for phrase in phrases:
        out = out | words.contains(f" {phrase} ")
    return out


def after(words: Column, phrase: str) -> Column:
    """What follows the first such phrase, with a blank before it; null without one."""
    return F.concat(F.lit(" "), F.get(F.split(words, f" {phrase} ", 2), F.lit(1)))


def before(words: Column, phrase: str) -> Column:
    """What stands before the first such phrase, all of it without one, trimmed."""
    return F.trim(F.substring_index(words, f" {phrase} ", 1))


def word(words: Column, phrase: str) -> Column:
    """The word that follows a phrase."""
    return F.substring_index(F.ltrim(after(words, phrase)), " ", 1)


def nth(words: Column, n: int) -> Column:
    """The n-th word from 0; null beyond the last."""
    return c.some(F.get(F.split(F.trim(words), " "), F.lit(n)))


def sentence(text: Column, phrase: str) -> Column:
    """The rest of the first sentence with a phrase, from behind the phrase."""
    held = F.filter(F.split(text, r"\."), lambda x: x.contains(f"{phrase} "))
    return F.trim(F.get(F.split(F.get(held, F.lit(0)), f"{phrase} ", 2), F.lit(1)))


def moved(text: Column) -> Column:
    """The three words that follow MOV, MOVG or MOVING, with FROM or TO before them, of a text whose blanks are single."""
    return F.regexp_extract(text, r"\bMOV(?:ING|G)? ((?:FROM |TO )?\S+(?: \S+){0,2})", 1)


def movement(text: Column) -> Column:
    return movement_of(moved(c.squeezed(text)))


def movement_of(words: Column) -> Column:
    """Direction in degrees or as a compass point, and speed in knots or kilometers an hour, of what `moved` found."""
    toward = F.regexp_replace(words, "^(FROM|TO) ", "")
    first = F.substring_index(toward, " ", 1)
    degrees = words.startswith("FROM ") & first.rlike("^[0-9]{5,6}[A-Z]")
    compass = ~words.startswith("FROM ") & first.rlike("^[NSEW]{1,3}$")
    rest = F.when(degrees, F.substring(toward, 4, 99)).when(compass, F.ltrim(F.substring(toward, F.length(first) + 1, F.lit(99))))
    pace = c.number(F.regexp_extract(rest, "^[0-9]{1,3}", 0))
    unit = F.regexp_extract(rest, "^[0-9]+ ?(KMH|KT)", 1)
    known = unit != ""
    return F.struct(
        F.when(degrees & known, c.number(F.substring(first, 1, 3))).alias("directionDeg"),
        F.when(compass & known, first).alias("directionCompass"),
        F.when(unit == "KT", pace).alias("speedKt"),
        F.when(unit == "KMH", pace).alias("speedKmPerHr"),
    )


def altitude_ft(level: Column) -> Column:
    """FLnnn or nnn in hundreds of feet; the surface and the freezing level have none."""
    digits = F.when(level.startswith("FL"), F.substring(level, 3, 9)).otherwise(level)
    return F.when((F.length(digits) == 3) & ~digits.rlike("[^0-9]"), c.number(digits) * 100)


def levels(words: Column) -> Column:
    """The two levels of BTN a AND b, else of the first word a/b; null without either."""

    def slashed(w: Column) -> Column:
        low, high = F.substring_index(w, "/", 1), F.get(F.split(w, "/"), F.lit(1))
        return w.contains("/") & altitude_ft(high).isNotNull() & ((low == "SFC") | altitude_ft(low).isNotNull())

    spoken = F.split(F.substring_index(F.ltrim(after(words, "BTN")), " ", 3), " ")
    joined = F.get(F.filter(F.split(words, " "), slashed), F.lit(0))
    named = (F.get(spoken, F.lit(1)) == "AND") & altitude_ft(F.get(spoken, F.lit(2))).isNotNull()
    return F.when(named, F.array(F.get(spoken, F.lit(0)), F.get(spoken, F.lit(2)))).otherwise(F.split(joined, "/"))


def altitude_range(words: Column) -> Column:
    return altitude_range_of(levels(words))


def altitude_range_of(pair: Column) -> Column:
    """What `levels` found, as written and in feet."""
    low, high = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    return F.when(pair.isNotNull(), F.struct(low.alias("base"), altitude_ft(low).alias("baseFt"), high.alias("top"), altitude_ft(high).alias("topFt")))


def top_words(words: Column) -> Column:
    """The three words behind TOPS or TOP; null without them."""
    return F.slice(F.split(F.ltrim(F.coalesce(after(words, "TOPS"), after(words, "TOP"))), " "), 1, 3)


def tops(behind: Column) -> Column:
    """The flight level that `top_words` name, in feet, and whether ABV stands before it; null without a level."""
    level = F.get(F.filter(behind, lambda w: ~w.isin("ABV", "TO")), F.lit(0))
    return F.when(level.startswith("FL"), F.struct(altitude_ft(level).alias("altitudeFt"), (F.get(behind, F.lit(0)) == "ABV").alias("isAbove")))


def intensity_change(words: Column) -> Column:
    return F.when(says(words, "INTSF", "INTSFYG"), "INTENSIFYING").when(says(words, "WKN", "WKNG"), "WEAKENING").when(says(words, "NC"), "NO_CHANGE")


# fixed values: words that end the points of an area
AREA_ENDS = "AREA BTN CIG CONDS DMSHG DVLPG ISOL LINE LLWS MOD MOV MTN MTNS OCNL OUTLOOK SEV STNR SUSTAINED VA VIS VOLCANIC".split()


def area_points(words: Column) -> Column:
    """The points between FROM and the first word of weather, parted by hyphens or TO; FROM of an eruption or a movement begins none."""
    plain = F.regexp_replace(words, " FROM ERUPTION | (?:MOV|MOVG|MOVING) FROM ", " ")
    span = F.coalesce(F.get(F.split(after(plain, "FROM"), f" (?:{'|'.join(AREA_ENDS)}) ", 2), F.lit(0)), F.lit(""))
    return F.filter(F.transform(F.split(span, "-| TO "), lambda p: F.trim(p)), lambda p: p != "")


def position(text: Column) -> Column:
    """Degrees of the first position written [NS]DDMM [EW]DDDMM."""
    pair = c.found(text, "[NS][0-9]{4} [EW][0-9]{5}", 0)

    def degrees(word_: Column, width: int, negative: str) -> Column:
        whole, minutes = F.substring(word_, 2, width), F.substring(word_, 2 + width, 2)
        return (whole.cast("double") + minutes.cast("double") / 60) * F.when(word_.startswith(negative), -1).otherwise(1)

    lat, lon = degrees(F.substring_index(pair, " ", 1), 2, "S"), degrees(F.substring_index(pair, " ", -1), 3, "W")
    return F.when(pair.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def positions(text: Column) -> Column:
    """All such positions in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("[NS][0-9]{4} [EW][0-9]{5}"), F.lit(0)), position)
