"""Members of ZIP archives as tables, read through Spark's own file access, nested archives included.

An archive is one row of bytes, opened where the row is; its members are inflated as they are read and
leave in batches of bounded size. An archive's directory stands at its end, so one archive is one
task: hand over many archives, or write a large one's lines once and read those.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

#: Characters of a batch of lines; a longer line is a batch by itself.
BATCH = 1 << 20

_LINES = "archive string, member string, ord long, value string"
_MEMBERS = "archive string, member string, content string"


def _opened(file: io.IOBase, name: str) -> Iterator[tuple[str, zipfile.ZipFile, zipfile.ZipInfo]]:
    """(name, archive, entry) of every file in an archive and, by outer/inner names, in the archives within."""
    with zipfile.ZipFile(file) as archive:
        for entry in archive.infolist():
            if entry.is_dir():
                continue
            path = f"{name}/{entry.filename}" if name else entry.filename
            if entry.filename.lower().endswith(".zip"):
                with archive.open(entry) as inner:
                    yield from _opened(inner, path)
            else:
                yield path, archive, entry


def _chosen(content: bytes, pattern: str) -> Iterator[tuple[str, zipfile.ZipFile, zipfile.ZipInfo]]:
    wanted = re.compile(pattern, re.IGNORECASE)
    for path, archive, entry in _opened(io.BytesIO(content), ""):
        if wanted.search(path):
            yield path, archive, entry


def _batches_of_lines(archive: str, content: bytes, pattern: str, encoding: str, batch: int) -> Iterator[pa.RecordBatch]:
    for path, opened, entry in _chosen(content, pattern):
        values: list[str] = []
        first = size = 0

        def packed() -> pa.RecordBatch:
            n = len(values)
            columns = [pa.array([archive] * n), pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["archive", "member", "ord", "value"])

        with opened.open(entry) as raw, io.TextIOWrapper(raw, encoding, errors="replace", newline="\n") as text:
            for line in text:
                values.append(line.rstrip("\r\n"))
                size += len(line)
                if size >= batch:
                    yield packed()
                    first, size, values = first + len(values), 0, []
        if values:
            yield packed()


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("archive"), "content")


def lines(spark: SparkSession, path: str, pattern: str = "", encoding: str = "utf-8", batch: int = BATCH) -> DataFrame:
    """(archive, member, ord, value): lines, from 0, of the members whose path matches the pattern anywhere.

    A member within an inner archive is `inner.zip/name`. Line ends go; bytes that the encoding
    lacks become U+FFFD; an empty member has no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for archive, content in zip(given.column("archive"), given.column("content")):
                yield from _batches_of_lines(archive.as_py(), content.as_py(), pattern, encoding, batch)

    return _files(spark, path).mapInArrow(read, _LINES)


def documents(spark: SparkSession, path: str, pattern: str = "", encoding: str = "utf-8") -> DataFrame:
    """(archive, member, content): whole members as text, one row and batch each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for archive, content in zip(given.column("archive"), given.column("content")):
                for name, opened, entry in _chosen(content.as_py(), pattern):
                    columns = [pa.array([x]) for x in (archive.as_py(), name, opened.read(entry).decode(encoding, "replace").lstrip("﻿"))]
                    yield pa.RecordBatch.from_arrays(columns, ["archive", "member", "content"])

    return _files(spark, path).mapInArrow(read, _MEMBERS)


def csv(spark: SparkSession, path: str, pattern: str, columns: list[str], quoted: bool = True) -> DataFrame:
    """The named columns of comma-separated members with a header each, as text, and archive, member and ord.

    A header names its member's columns whatever their order; one that a member lacks is null. Values
    hold no line ends. Blanks around values go and empty ones are null, as text.csv has them.
    """
    rows = lines(spark, path, pattern).where(F.trim("value") != "")
    first = rows.where("ord = 0").select("archive", "member", F.regexp_replace("value", "^﻿", "").alias("value"))
    names = first.select("archive", "member", F.transform(_cells(F.col("value"), quoted), lambda c: F.upper(F.trim(c))).alias("names"))
    cells = rows.where("ord > 0").select("archive", "member", "ord", _cells(F.col("value"), quoted).alias("cells"))
    joined = cells.join(names, ["archive", "member"])
    places = {c: F.array_position("names", c.upper()).cast("int") for c in columns}
    values = [F.when(at > 0, F.nullif(F.trim(F.get("cells", at - 1)), F.lit(""))).alias(c) for c, at in places.items()]
    return joined.select("archive", "member", "ord", *values)


def _cells(line: Column, quoted: bool) -> Column:
    """The fields of one line: split at commas, in which those between quotation marks don't count."""
    if not quoted:
        return F.split(line, ",", -1)
    # an even number of marks follows every comma that parts fields
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = F.transform(parts, lambda c: F.when(F.trim(c).rlike('^".*"$'), F.regexp_replace(F.regexp_extract(F.trim(c), '^"(.*)"$', 1), '""', '"')).otherwise(c))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ",", -1))
