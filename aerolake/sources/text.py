"""Lines, comma-separated and fixed-width files as tables of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (first column from 1, width, kind); kinds are text, number, whole, and a letter that means true.
Layout = dict[str, tuple[int, int, str]]

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"
_WHOLE = r"^[\x00-\x20\x7f]*([+-]?\d+)"


def number(text: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(F.trim(text), _NUMBER, 0).try_cast("double")


def whole(text: Column) -> Column:
    """The whole number that a text begins with, else null.

    Nothing but digits is cast, since a cast that fails costs an exception, blank texts too.
    """
    return F.nullif(F.regexp_extract(given(text), _WHOLE, 1), F.lit("")).try_cast("int")


def given(text: Column) -> Column:
    """The text without outer blanks; blank is null."""
    return F.nullif(F.trim(text), F.lit(""))


def flag(text: Column, letter: str = "Y") -> Column:
    """true where the text is the letter, else null."""
    return F.when(text == letter, F.lit(True))


def code(text: Column, names: dict[str, str]) -> Column:
    """The name of a code, null where it has none."""
    if not names:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), text)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of each line with a character; a carriage return at its end goes."""
    read = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("value"))
    return read.where("value <> ''")


def fields(line: Column, layout: Layout) -> list[Column]:
    """The layout's columns of a line; a place beyond its end is blank."""
    readers = {"text": given, "number": number, "whole": whole}
    out = []
    for name, (start, width, kind) in layout.items():
        part = F.substring(line, start, width)
        out.append((readers[kind](part) if kind in readers else flag(F.trim(part), kind)).alias(name))
    return out


def csv(spark: SparkSession, path: str, quoted: bool = True) -> DataFrame:
    """A comma-separated file with a header: text columns, blanks around values gone, empty ones null, and ord.

    quoted=False reads files in which quotation marks mean nothing.
    """
    options = {"header": True, "enforceSchema": False, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    options |= {"quote": '"', "escape": '"', "multiLine": True} if quoted else {"quote": ""}
    read = spark.read.csv(path, **options)
    named = read.toDF(*[c.lstrip("﻿").strip().strip('"') for c in read.columns])
    cleaned = [given(F.col(f"`{c}`")).alias(c) for c in named.columns if c]
    return named.select(F.monotonically_increasing_id().alias("ord"), *cleaned)


def csv_column(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows with the fields of one comma-separated line of text under the names, the column gone."""
    schema = ", ".join(f"`{n}` string" for n in names)
    read = rows.withColumn(column, F.from_csv(column, schema, {"escape": '"'}))
    return read.select(*[c for c in rows.columns if c != column], *[given(F.col(f"{column}.`{n}`")).alias(n) for n in names])
