"""Line-first quality rules, built from Spark's own functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail go, and a
document that loses too much of its text goes with them. All work is a projection of one row: no
shuffle, no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shorter documents fail, as do those where more than this percentage of words repeats.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: A document stays while the lines it loses hold at most this share of its word characters.
MOST_LOST = 0.3

SPACE = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
#: Ends of sentences, also before closing quotes or brackets.
SENTENCE_END = r"[.!?:;…][\"'”’»)\]]*[ \t-\r]*$"
SENTENCE_MARK = r"[.,;:!?…]"
SEPARATOR = r"[|>»•·]"
LOUD = r"(!!|[#*$%&|<>])"
BOILERPLATE = (
    "lorem ipsum",
    "cookie policy",
    "uses cookies",
    "enable javascript",
    "javascript is disabled",
    "terms of use",
    "terms of service",
    "privacy policy",
    "all rights reserved",
    "licensed under",
    "released under the",
    "click here",
    "skip to content",
    "subscribe to our",
    "share this",
    "read more",
    "back to top",
    "powered by",
    "page not found",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, r"[\t-\r]", " "), " "), "")


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.lit(1 << 30))


def _line_measures(lines: Column, lowered: Column) -> Column:
    """Each line with what the rules look at, every expression run over it once."""

    def measure(line: Column, low: Column) -> Column:
        phrases = F.lit(False)
        for phrase in BOILERPLATE:
            phrases = phrases | low.contains(phrase)
        return F.struct(
            line.alias("line"),
            F.size(_words(line)).alias("words"),
            _count(line, SEPARATOR).alias("separators"),
            _count(line, LOUD).alias("loud"),
            phrases.alias("phrase"),
        )

    return F.zip_with(lines, lowered, measure)


def _rule(x: Column) -> Column:
    """Name of the first rule that a measured line fails, or null. Lines without a word never fail.

    boilerplate: one of the fixed phrases. navigation: at least three separators, no fewer than a
    third of the words. punctuation: as many shouted or symbol marks as half the words, or a
    fragment of fewer than four words that no sentence mark ends, or twelve words without any mark.
    """
    return (
        F.when(x["words"] == 0, None)
        .when(x["phrase"], "boilerplate")
        .when((x["separators"] >= 3) & (x["separators"] * 3 >= x["words"]), "navigation")
        .when((x["words"] >= 4) & (x["loud"] * 2 >= x["words"]), "punctuation")
        .when((x["words"] < 4) & ~x["line"].rlike(SENTENCE_END), "punctuation")
        .when((x["words"] >= 12) & ~x["line"].rlike(SENTENCE_MARK), "punctuation")
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def judge(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with the columns of the verdict added (names that clash are replaced).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_lost,
    chars_lost, kept, and clean_text: the text without its failing lines. A word is a run of
    characters other than space and tab to carriage return. Null text counts as empty, has no
    words and fails; clean_text is then empty. Each row is judged by itself, repeated rows alike.
    """
    names = [c for c in docs.columns]
    row = docs.select(*names, F.coalesce("text", F.lit("")).alias("__text"))
    row = row.withColumn("__words", _words("__text"))
    row = row.withColumn("__lines", F.split("__text", "\n"))
    # three words and the place of the first, sorted: equal windows come to stand side by side
    words = F.col("__words")
    pairs = F.zip_with(words, _shifted(words, 1), lambda a, b: F.concat(a, F.lit(" "), b))
    windows = F.slice(F.zip_with(pairs, _shifted(words, 2), lambda a, b: F.concat(a, F.lit(" "), b)), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    row = row.withColumn("__plain", windows)
    placed = F.sort_array(F.transform("__plain", lambda w, i: F.concat(w, F.lit(" "), (i + 1_000_000_000).cast("string"))))
    some_repeat = F.size(F.array_distinct("__plain")) < F.size("__plain")
    row = row.withColumn("__windows", F.when(some_repeat, placed).otherwise(F.array().cast("array<string>")))

    def place(window: Column) -> Column:
        return F.right(window, F.lit(10)).cast("int")

    def twins(a: Column, b: Column) -> Column:
        return F.when(b.startswith(F.substr(a, F.lit(1), F.length(a) - 10)), F.array(place(a), place(b)))

    row = row.withColumn("__twice", F.array_compact(F.zip_with("__windows", _shifted(F.col("__windows"), 1), twins)))
    row = row.withColumn("__starts", F.sort_array(F.array_distinct(F.flatten("__twice"))))
    gaps = F.zip_with("__starts", _shifted(F.col("__starts"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long"))
    row = row.withColumn("__measured", _line_measures(F.col("__lines"), F.split(F.lower("__text"), "\n")))
    judged = F.transform("__measured", lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), _rule(x).alias("rule")))
    row = row.withColumn("__judged", judged)
    lost = F.filter("__judged", lambda x: x["rule"].isNotNull())
    row = row.withColumn("__lost", F.transform(lost, lambda x: _word_chars(x["line"])))
    row = row.withColumn("__worded", F.transform(F.filter("__measured", lambda x: x["words"] > 0), lambda x: x["line"]))

    def total(values: Column | str) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)

    measures = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": _count(F.col("__text"), SYMBOLS),
        "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
        "n_repeat_words": total(gaps),
        "n_lines_lost": F.size("__lost").cast("long"),
        "chars_lost": total("__lost"),
        "clean_text": F.array_join(F.transform(F.filter("__judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"),
    }
    row = row.select(*[c for c in names if c not in {*measures, "base_failed", "kept"}], *[v.alias(k) for k, v in measures.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return row.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("chars_lost") <= MOST_LOST * F.col("word_chars")))


def oracle() -> str:
    """The verdicts in SQL, windows counted row by row."""
    space = r"[ \t-\r]"

    def n(text: str, pattern: str) -> str:
        return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"

    def has(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"

    words = r"[^ \t-\r]+"
    return f"""
        with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
        w as (select r, doc_id, t, regexp_extract_all(t, '{words}') as words from d),
        x as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win from w, unnest(range(1, len(words) - 1)) as u(i)),
        y as (select r, i from (select r, i, count(*) over (partition by r, win) as c from x) where c > 1),
        z as (select r, count(distinct i + k) as n_repeat_words from y, range(3) as s(k) group by r),
        l as (select r, unnest(string_split(t, chr(10))) as line from d),
        m as (select r, line, {n('line', words)} as nw, {n('line', SEPARATOR)} as ns, {n('line', LOUD)} as nl, {" or ".join(f"contains(lower(line), '{p}')" for p in BOILERPLATE)} as b,
            {has('line', SENTENCE_END)} as e, {has('line', SENTENCE_MARK)} as p from l),
        f as (select *, nw > 0 and (b or (ns >= 3 and ns * 3 >= nw) or (nw >= 4 and nl * 2 >= nw) or (nw < 4 and not e) or (nw >= 12 and not p)) as bad from m),
        g as (select r, count(*) filter (nw > 0) - count(distinct case when nw > 0 then line end) as n_dup_lines, count(*) filter (bad) as n_lines_lost,
            coalesce(sum(length(regexp_replace(line, '{space}', '', 'g'))) filter (bad), 0) as chars_lost from f group by r),
        a as (select w.r, doc_id, len(words) as n_words, length(regexp_replace(t, '{space}', '', 'g')) as word_chars, {n('t', SYMBOLS)} as n_symbols,
            n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, n_lines_lost, chars_lost from w join g using (r) left join z using (r)),
        v as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from a)
        select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
            n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and chars_lost <= {MOST_LOST} * word_chars as kept,
            n_lines_lost::bigint as n_lines_lost, chars_lost::bigint as chars_lost from v"""
