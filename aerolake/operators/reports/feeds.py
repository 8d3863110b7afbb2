"""Feeds of many reports: splitting, and reading with the failures set apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blocks(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def lines(text: Column) -> Column:
    return _blocks(text, r"\r?\n")


def tafs(text: Column) -> Column:
    """Parted by blank lines, or where a line begins with TAF."""
    return _blocks(text, r"(?:\r?\n){2,}|\r?\n(?=TAF\b)")


def bulletins(text: Column) -> Column:
    """Parted by a line of ten or more dashes; leading blank, Type: and Hazard: lines go."""
    parts = F.split(text, r"(?m)^[ \t]*-{10,}[ \t]*$")
    bare = F.transform(parts, lambda b: F.regexp_replace(b, r"^(?:[ \t]*(?:(?:Type|Hazard):[^\n]*)?(?:\r?\n|$))+", ""))
    return F.filter(F.transform(bare, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def split(feed: DataFrame, how: Callable[[Column], Column], text: str = "value", raw: str = "raw") -> DataFrame:
    """One row per report of each text, with its position."""
    return feed.select(*[c for c in feed.columns if c != text], F.posexplode(how(F.col(text))).alias("position", raw))


def parse_records(reports: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results, errors): what the reader made of each report, and raw and error of those it could not read."""
    read = parse(reports)
    kept = [c for c in reports.columns if c in read.columns]
    return read.where(F.col("error").isNull()).drop("error"), read.where(F.col("error").isNotNull()).select(*kept, "error")
