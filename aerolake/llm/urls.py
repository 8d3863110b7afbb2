"""URL verdicts: host and path rules first, then pattern rules found through their rarest token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path) of the host rules.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Pattern:
    """A blocking expression over the lower-cased url, and literal tokens that each match contains.

    A token is a whole run of a-z and 0-9 in the url.
    """

    name: str
    expression: str
    tokens: tuple[str, ...]


PATTERNS = (
    Pattern("listing page", r"[?&]page=[0-9]+(&|#|$)", ("page",)),
    Pattern("tag listing", r"/tag/[^/?#]+/page/[0-9]+", ("tag", "page")),
    Pattern("print view", r"[?&]print=(1|true|yes)(&|#|$)", ("print",)),
    Pattern("login form", r"/wp-login[.]php", ("wp", "login")),
    Pattern("admin area", r"/wp-admin(/|$)", ("wp", "admin")),
    Pattern("session id", r"[?&;]phpsessid=[0-9a-z]+", ("phpsessid",)),
    Pattern("cart", r"/cart(/|[?]|$)", ("cart",)),
    Pattern("checkout", r"/checkout(/|[?]|$)", ("checkout",)),
    Pattern("calendar", r"/calendar/[0-9]{4}/[0-9]{1,2}", ("calendar",)),
    Pattern("advert host", r"^[a-z]+://([^/?#]*[.])?ads[.]", ("ads",)),
    Pattern("casino", r"[./-]casino[./-]", ("casino",)),
    Pattern("adult", r"[./-]xxx[./-]", ("xxx",)),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
_TOKEN = re.compile(r"[a-z0-9]+")


def token_counts(pages: DataFrame, tokens: set[str]) -> dict[str, int]:
    """Pages that hold each of the rules' tokens: as many rows reach the driver as there are tokens."""
    url = F.translate(F.coalesce("url", F.lit("")), _UPPER, _LOWER)
    each = pages.select(F.explode(F.array_distinct(F.split(url, "[^a-z0-9]+"))).alias("token"))
    rows = each.where(F.col("token").isin(sorted(tokens))).groupBy("token").count().collect()
    return {row[0]: row[1] for row in rows}


def rule_index(patterns: tuple[Pattern, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token of each rule to the numbers of the rules it stands for."""
    index: dict[str, list[int]] = {}
    for n, pattern in enumerate(patterns):
        rarest = min(pattern.tokens, key=lambda t: (counts.get(t, 0), t))
        index.setdefault(rarest, []).append(n)
    return index


def _match_batches(patterns: tuple[Pattern, ...], index: dict[str, list[int]]):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p.expression) for p in patterns]
        for batch in batches:
            hits = []
            for url in batch.column("url").to_pylist():
                hit = None
                if url is not None:
                    low = url.translate(_ASCII_LOWER)
                    rules = sorted({n for t in set(_TOKEN.findall(low)).intersection(index) for n in index[t]})
                    hit = next((patterns[n].name for n in rules if compiled[n].search(low)), None)
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hits, pa.string())], ["page_id", "url", "pattern"])

    return matches


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, name, start = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(start)


def judge(pages: DataFrame, rules=HOST_RULES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of each row of `pages`.

    Of the host rules that fit, the longest decides and `rule` is its host and path; where none
    fits, a url that any pattern matches is blocked and `pattern` names the first. A null url, or
    one without "://", has empty host and path. Repeated rows are judged each by itself.
    """
    common.ready(pages.sparkSession)
    pages = pages.select("page_id", "url")
    index = rule_index(patterns, token_counts(pages, {t for p in patterns for t in p.tokens}))
    found = pages.mapInArrow(_match_batches(patterns, index), "page_id long, url string, pattern string")
    url = F.coalesce("url", F.lit(""))
    parts = found.select(
        "page_id",
        "pattern",
        F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("pattern").isNull(), "allow").otherwise("block")
    for decided in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(F.col("host"), F.col("path"), decided)
        rule, verdict = F.when(fits, decided[1] + decided[2]).otherwise(rule), F.when(fits, decided[0]).otherwise(verdict)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "pattern")


def oracle() -> str:
    """The same verdicts in SQL, every pattern run on every url."""
    case_rule, case_verdict = [], []
    for verdict, host, path in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"
        case_rule.append(f"when {fits} then '{host}{path}'")
        case_verdict.append(f"when {fits} then '{verdict}'")
    names = " ".join(f"when regexp_matches(low, '{p.expression}') then '{p.name}'" for p in PATTERNS)
    return f"""
        with u as (select page_id, coalesce(url, '') as url, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') as low from pages),
        p as (select page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
            regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, case {names} end as pattern from u)
        select page_id, host, path, case {' '.join(case_rule)} end as rule,
            case {' '.join(case_verdict)} when pattern is null then 'allow' else 'block' end as verdict, pattern from p"""
