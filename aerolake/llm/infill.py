"""Fill-in-middle: documents cut at unit borders into prefix, middle and suffix, and put together anew.

Units are rows. A document's units are exploded with their places, a window sums their lengths,
a document's two cut requests join the sums by unit ordinal, and the offsets that come of it are
gathered per document to take its three parts as substrings. Documents are dealt once, by their
key; units, requests and texts all stand on that one dealing, so no unit is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: White space and the word after it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many are rearranged, and of 100 of those so many have the suffix first.
RATE = 50
SUFFIX_FIRST = 80
SEED = 42

#: The document's number (0: none) and a hash of its text whose lowest bit tells that there is none.
_KEY = ["did", "th"]


def _keyed(docs: DataFrame) -> DataFrame:
    missing = F.col("doc_id").isNull()
    hashed = F.shiftleft(F.xxhash64("text"), 1).bitwiseOR(missing.cast("long"))
    return common.texts(docs).select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("did"), hashed.alias("th"), "text")


def _doc_id() -> Column:
    return F.when(F.col("th").bitwiseAND(1) == 0, F.col("did"))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on the seed and the document's number alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]


def _plain(seed: int, rate: int) -> Column:
    """Whether a text stays as it is: an empty one, one that holds a marker, and by the draw."""
    text, draw = F.col("text"), _draws(_doc_id(), seed)[2]
    return (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (draw % 100 >= rate)


def _requests(base: DataFrame, seed: int, rate: int, suffix_first: int) -> DataFrame:
    """Of each key that isn't plain its number of units and of equal rows, its form and the ordinals of its two cuts."""
    counted = base.select(*_KEY, F.when(~_plain(seed, rate), F.regexp_count("text", F.lit(UNIT)).cast("long")).alias("n"))
    once = counted.groupBy(*_KEY).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")).where(F.col("n").isNotNull())
    h1, h2, _, h4 = _draws(_doc_id(), seed)
    drawn = once.select(*_KEY, "n", "copies", (h4 % 100 < suffix_first).alias("spm"), *[(h % (F.col("n") + 1)).alias(c) for h, c in ((h1, "a"), (h2, "b"))])
    return drawn.select(*_KEY, "n", "copies", "spm", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("last"))


def _running(base: DataFrame, seed: int, rate: int) -> DataFrame:
    """A row for each unit: its ordinal from 1, and the code points up to its end, summed over the key's equal rows.

    Ordinal 0 is the start of the text, before any unit. Plain texts have no rows: they are left out here
    and not by a filter, which would move below the dealing and make a second one of it.
    """
    units = F.when(~_plain(seed, rate), F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))))
    sized = base.select(*_KEY, F.posexplode(units).alias("ordinal", "unit")).select(*_KEY, "ordinal", F.length("unit").cast("long").alias("size"))
    upto = Window.partitionBy(*_KEY).orderBy("ordinal").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.select(*_KEY, "ordinal", F.sum("size").over(upto).alias("total"))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of `docs`.

    n counts the units. Form psm is prefix, suffix, middle; spm has the suffix first; plain leaves
    the text as it is, with null lengths: an empty text, one that holds a marker, and by the draw.
    The draws depend on the seed and on doc_id; a missing doc_id counts as no digits. A null text
    counts as empty. Rows that repeat come out alike, once each; texts that share a doc_id are
    documents of their own. Other columns of `docs` are left unread.
    """
    n = common.partitions(docs.sparkSession)
    base = _keyed(docs).repartition(n, *_KEY)
    running, requests = _running(base, seed, rate), _requests(base, seed, rate, suffix_first).toDF("d", "t", "n", "copies", "spm", "first", "last")
    cut = (F.col("ordinal") == F.col("first")) | (F.col("ordinal") == F.col("last"))
    # by sorting: the units, many times their texts, are never broadcast
    asked = running.hint("merge").join(requests, (F.col("did") == F.col("d")) & (F.col("th") == F.col("t")) & cut)

    def offset(at: str) -> Column:
        """Code points before a cut: the sum at its ordinal, over the rows that share the key."""
        return F.max(F.when(F.col("ordinal") == F.col(at), F.expr("total div copies")))

    offsets = asked.groupBy(*_KEY).agg(F.max("n").alias("n"), F.max("spm").alias("spm"), offset("first").alias("start"), offset("last").alias("end"))
    whole = base.join(offsets, _KEY, "left")
    parts = [F.substring("text", F.lit(1), F.col("start")), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), F.substring("text", F.col("end") + 1, F.length("text"))]
    psm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1])
    spm = F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
    form = F.when(F.col("spm"), "spm").when(~F.col("spm"), "psm").otherwise("plain")
    output = F.when(F.col("spm"), spm).when(~F.col("spm"), psm).otherwise(F.col("text"))
    units = F.coalesce("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    return whole.select(
        _doc_id().alias("doc_id"), units.alias("n"), form.alias("form"), F.col("start").alias("prefix_chars"), (F.col("end") - F.col("start")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: only its markers tell where the parts begin."""

    def between(opening: str, closing: str | None) -> Column:
        rest = F.substring(output, F.position(F.lit(opening), output) + len(opening), F.length(output))
        return F.substring_index(rest, closing, 1) if closing else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The lengths of `transform` with digests of each output and of the text rebuilt from it."""
    made = transform(docs)
    sha = F.sha2("output", 256).alias("output_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha, F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle() -> str:
    """The same rows in SQL, by list functions."""
    cuts = ", ".join(f"('0x' || substr(g, {8 * n + 1}, 8))::bigint as h{n + 1}" for n in range(4))
    part = "length(array_to_string(u[:{}], ''))"
    return f"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{UNIT}') as u,
            sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as g from documents),
        h as (select *, len(u)::bigint as n, {cuts} from d),
        f as (select *, case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain'
            when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
        c as (select *, case when form <> 'plain' then {part.format('a')} end as x, case when form <> 'plain' then {part.format('b')} end as y from f),
        p as (select *, substr(t, 1, x) as pre, substr(t, x + 1, y - x) as mid, substr(t, y + 1) as suf from c)
        select doc_id, n, form, x::bigint as prefix_chars, (y - x)::bigint as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
            sha256(t) as restored_sha256 from p"""
