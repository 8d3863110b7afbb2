"""International advisories, cut into clauses.

The head, up to the hyphen behind the issuing station, is read by the places of its words. What follows the region's
name is cut into clauses at the words that begin one; clauses from a timed forecast on belong to the forecast. Each
value is then read from the first clause of its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..steps import settled
from . import common as c
from . import phrases as p

# fixed values: phenomena as they are written, longer ones first; the words that end a region's name; those that may follow it
PHENOMENA = "SEV ICE (FZRA),SEV TURB,SEV ICE,FRQ TS,OBSC TS,EMBD TS,SQL TS,ISOL SEV TS,VA ERUPTION,VA CLD,RDOACT CLD,WDSPR DS,WDSPR SS".split(",")
REGIONS = "FIR UIR FIR/UIR CTA".split()
FOLLOWING = "SEV FRQ OBSC EMBD SQL ISOL TC VA RDOACT WDSPR CNL TS".split()
# fixed values: words that begin a clause, and the kind of clause
OPENERS = {
    "OBS": "OBS", "FCST": "FCST", "AREA WI": "AREA", "WI": "AREA", "ENTIRE": "ENTIRE", "CB TOP": "TOP", "TOP": "TOP", "TOPS": "TOP", "MOV": "MOV", "STNR": "STNR",
    "NC": "CHANGE", "INTSF": "CHANGE", "WKN": "CHANGE", "BTN": "LEVELS", "PSN": "PSN", "TC": "TC", "VA": "VA", "CNL": "CNL",
}
_LINE = "[NSEW]{1,3} OF LINE"
_LEVELS = "(?:SFC|FL[0-9]{3})/"
_CUTS = rf" (?=(?:{'|'.join(OPENERS)}|{_LINE})(?: |$))| (?={_LEVELS})"


def _identifier(words: Column) -> tuple[Column, Column]:
    """Name and number of `INDIA 2`, `A6` or `140`, the last named by its number."""
    one, two = F.substring_index(words, " ", 1), F.get(F.split(words, " "), F.lit(1))
    letters = F.regexp_extract(one, "^([A-Z]+)[0-9]+$", 1)
    fused = two.isNull() & (letters != "")
    name = F.when(fused, letters).otherwise(one)
    number = F.when(fused, F.substring(one, F.length(letters) + 1, F.lit(9))).otherwise(F.coalesce(two, one))
    return c.some(name), c.number(number)


def _with_head(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with __head, the parts of a head; null where the text has none of this format."""
    given = F.col(text)
    rows = settled(rows, F.split(F.substring_index(given, " VALID ", 1), " ").alias("__front"), F.get(F.split(given, " VALID ", 2), F.lit(1)).alias("__tail"))
    rows = settled(rows, F.substring_index("__tail", " ", 1).alias("__window"), F.split(F.get(F.split("__tail", " ", 2), F.lit(1)), "-", 2).alias("__rest"))
    front, n, window = F.col("__front"), F.size("__front"), F.col("__window")
    kind = F.when(F.get(front, n - 2) == "SIGMET", 1).when(F.get(front, n - 3) == "SIGMET", 2)
    station, body = F.trim(F.get("__rest", F.lit(0))), F.get("__rest", F.lit(1))
    fits = kind.isNotNull() & window.rlike("^[0-9]{6}/[0-9]{6}$") & station.rlike("^[A-Z]{4}$") & body.isNotNull()
    rows = settled(rows, F.when(fits, kind).alias("__words_in"), F.when(fits, F.split(F.trim(p.said(F.substring_index(body, "=", 1))), " ")).alias("__said"))
    code = F.get(front, n - F.col("__words_in") - 2)
    head = F.struct(
        F.array_join(F.slice(front, -F.col("__words_in"), F.col("__words_in")), " ").alias("identifier"), window.alias("window"), station.alias("station"),
        F.when(code.rlike("^[A-Z]{4}$"), code).alias("code"), F.col("__said").alias("words"), c.found(given, r"\bINCLUDES [^=]+", 0).alias("more"),
    )
    return settled(rows, F.when(F.col("__words_in").isNotNull(), head).alias("__head")).drop("__front", "__tail", "__window", "__rest", "__words_in", "__said")


def _region(head: Column) -> Column:
    """How many words the region's name takes: to the first ending with a phenomenon behind it, else to the first ending."""
    words = head["words"]
    place = F.sequence(F.lit(0), F.size(words) - 1)
    followed = F.filter(place, lambda i: F.get(words, i).isin(REGIONS) & F.get(words, i + 1).isin(FOLLOWING))
    ends = [F.nullif(F.array_position(words, F.lit(x)), F.lit(0)) for x in REGIONS]
    return F.coalesce(F.get(followed, F.lit(0)) + 1, F.least(*ends).cast("int"), F.lit(0))


def _kind(piece: Column) -> Column:
    """The kind of the clause that begins like this piece: by its first word, or by two."""
    single = F.create_map(*[F.lit(x) for item in OPENERS.items() if " " not in item[0] for x in item])
    out = F.try_element_at(single, F.substring_index(piece, " ", 1))
    for opener, name in OPENERS.items():
        if " " in opener:
            out = F.coalesce(out, F.when((piece == opener) | piece.startswith(f"{opener} "), name))
    return F.coalesce(out, F.when(piece.rlike(f"^{_LINE} "), "AREA"), F.when(piece.rlike(f"^{_LEVELS}"), "LEVELS"), F.lit("PHENOMENON"))


def with_clauses(reports: DataFrame, text: str) -> DataFrame:
    """`reports` with __head (null for other formats), __name, __content and __clauses of a text whose blanks are single.

    A clause has what it belongs to, its kind and its words.
    """
    rows = _with_head(reports, text)
    rows = settled(rows, _region(F.col("__head")).alias("__region"))
    words = F.col("__head.words")
    rest = F.concat(F.lit(" "), F.array_join(F.slice(words, F.col("__region") + 1, F.size(words)), " "), F.lit(" "))
    rows = settled(rows, F.array_join(F.slice(words, F.lit(1), F.col("__region")), " ").alias("__name"), F.when(F.col("__head").isNotNull(), rest).alias("__content"))
    rows = settled(rows, F.filter(F.split(F.trim("__content"), _CUTS), lambda x: x != "").alias("__pieces"))
    rows = settled(rows, F.array_position(F.transform("__pieces", lambda x: x.rlike("^FCST (?:AT )?[0-9]{4}Z")), F.lit(True)).alias("__forecast"))
    first = F.col("__forecast")
    each = F.transform("__pieces", lambda x, i: F.struct(F.when((first > 0) & (i >= first - 1), "FORECAST").otherwise("PRESENT").alias("owner"), _kind(x).alias("kind"), x.alias("text")))
    return settled(rows, each.alias("__clauses"))


def clauses(reports: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per clause of each international advisory: position, owner (PRESENT or FORECAST), kind, text; others have none."""
    rest = [x for x in reports.columns if x != raw]
    rows = with_clauses(settled(reports, c.squeezed(F.col(raw)).alias("__text")), "__text")
    return rows.select(*rest, F.posexplode("__clauses").alias("position", "__clause")).select(*rest, "position", "__clause.*")


def with_fields(rows: DataFrame, prefix: str) -> DataFrame:
    """`rows` of `with_clauses` with a column, named with the prefix, for each value, null for other formats.

    What a clause says is a step, what its words say the next; the last puts the values together.
    """
    content, said, start = F.col("__content"), F.col("__clauses.text"), F.col("__start")

    def among(kinds: Column) -> Column:
        return F.slice(kinds, start, F.size(kinds))

    def first(kind: str, owner: str | None = None) -> Column:
        """The first clause of a kind, among all, those before the forecast or those of it."""
        if owner == "FORECAST":
            return F.get(among(said), F.array_position(among(F.col("__clauses.kind")), F.lit(kind)).cast("int") - 1)
        at = F.array_position("__clauses.kind", F.lit(kind)).cast("int")
        return F.get(said, (at if owner is None else F.when(at < start, at)) - 1)

    later = F.array_join(among(said), " ")
    rows = settled(rows, F.when(F.col("__forecast") > 0, F.col("__forecast").cast("int")).otherwise(F.size("__clauses") + 1).alias("__start"))
    rows = settled(
        rows, F.col("__name").rlike("^[A-Z]{4} .* ").alias("__coded"), p.after(content, "CNL SIGMET").alias("__ended"), c.some(later).alias("__later"), p.word(content, "TC").alias("__cyclone"), p.after(content, "VA ERUPTION").alias("__eruption"),
        first("OBS", "PRESENT").alias("__seen"), first("FCST", "PRESENT").isNotNull().alias("__foreseen"), F.coalesce(first("AREA", "PRESENT"), first("AREA")).alias("__place"), first("AREA", "FORECAST").alias("__later_place"),
        first("LEVELS", "FORECAST").alias("__later_levels"), first("ENTIRE").isNotNull().alias("__entire"), p.levels(content).alias("__levels"), p.top_words(content).alias("__top"), p.moved(content).alias("__moved"), p.word(content, "CB TOP").alias("__cb"),
    )

    def area(text: str) -> Column:
        return F.regexp_replace(text, f"^(?:AREA WI|WI|{_LINE}) ", "")

    window = F.when(p.nth(F.col("__ended"), 1).contains("/"), p.nth(F.col("__ended"), 1)).when(p.nth(F.col("__ended"), 2).contains("/"), p.nth(F.col("__ended"), 2))
    expected = p.after(F.concat(F.lit(" "), F.col("__later")), "TC CENTER")
    rows = settled(
        rows, window.alias("__window"), F.when(F.col("__seen").rlike("^OBS AT [0-9]{4}Z"), F.substring("__seen", 8, 5)).alias("__seen_at"), area("__place").alias("__near"), area("__later_place").alias("__later_area"),
        c.found(F.col("__later"), "[0-9]{4}Z", 0).alias("__later_at"), expected.alias("__expected"), p.levels(F.concat(F.lit(" "), F.col("__later_levels"), F.lit(" "))).alias("__later_pair"),
        F.when(window.isNotNull(), F.trim(F.substring_index(F.col("__ended"), "/", 1))).alias("__gone"),
    )
    rows = settled(rows, F.regexp_replace("__gone", " ?[0-9]+$", "").alias("__gone_id"))
    head, region = F.col("__head"), F.col("__name")
    series, number = _identifier(head["identifier"])
    gone, gone_number = _identifier(F.col("__gone_id"))
    phenomenon = F.lit(None).cast("string")
    for phrase in reversed(PHENOMENA):
        phenomenon = F.when(content.startswith(f" {phrase} "), phrase).otherwise(phenomenon)
    cyclone, near, eruption, seen = (F.col(x) for x in ("__cyclone", "__near", "__eruption", "__seen"))
    radius = F.when(near.endswith("NM OF CENTER"), c.number(F.rtrim(F.substring_index(near, "NM", 1))))

    def ends(span: Column) -> list[Column]:
        return [c.day_time_of(F.substring_index(span, "/", 1)).alias("validFrom"), c.day_time_of(F.substring_index(span, "/", -1)).alias("validTo")]

    values = [
        series.alias("seriesName"), number.alias("number"), *ends(head["window"]),
        head["station"].alias("issuingStation"), F.coalesce(head["code"], F.when(F.col("__coded"), F.substring(region, 1, 4))).alias("firCode"),
        c.some(F.when(F.col("__coded"), F.substring(region, 6, 999)).otherwise(region)).alias("firName"), F.col("__ended").isNotNull().alias("isCancellation"),
        F.when(F.col("__window").isNotNull(), F.struct(gone.alias("seriesName"), gone_number.alias("number"), *ends(F.col("__window")))).alias("cancelled"),
        F.coalesce(phenomenon, F.concat(F.lit("TC "), cyclone)).alias("phenomena"),
        F.when(F.col("__seen_at").isNotNull() | (seen != "OBS AND"), "OBSERVED").when(F.col("__foreseen") & F.col("__later").isNull(), "FORECAST").alias("observationStatus"),
        c.day_time_of(F.col("__seen_at")).alias("observedAt"), c.some(near).alias("areaDescription"), p.positions(F.col("__place")).alias("areaRing"), F.col("__entire").alias("isEntireRegion"),
        p.altitude_range_of(F.col("__levels")).alias("altitudes"), p.tops(F.col("__top")).alias("tops"), p.movement_of(F.col("__moved")).alias("movement"), p.says(content, "STNR").alias("isStationary"),
        p.intensity_change(content).alias("intensityChange"), cyclone.alias("cycloneName"), F.when(cyclone.isNotNull(), p.position(content)).alias("cyclonePosition"),
        F.when(cyclone.isNotNull(), c.number(F.substring("__cb", 3, 3))).alias("cbTopFl"), F.when(cyclone.isNotNull(), radius).alias("withinNm"),
        c.day_time_of(F.col("__later_at")).alias("forecastTime"), p.position(F.substring(F.ltrim("__expected"), 1, 12)).alias("forecastPosition"),
        F.col("__later_area").alias("forecastArea"), p.altitude_range_of(F.col("__later_pair")).alias("forecastAltitudes"),
        F.when(eruption.isNotNull(), p.before(eruption, "PSN")).alias("volcanoName"), p.position(p.after(eruption, "PSN")).alias("volcanoPosition"),
        F.trim(head["more"]).alias("additionalInfo"),
    ]
    names = rows.select(*values).columns
    return settled(rows, *[F.when(head.isNotNull(), v).alias(f"{prefix}{n}") for n, v in zip(names, values)])
