"""Lookups and searches. A table of questions is joined to a data set, so one question or millions
take the same path. Data sets carry `ord`, the order of input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEARCH_LIMIT = 20


def last_by_key(data: DataFrame, key: Column) -> DataFrame:
    """One row per upper-cased key, the last in input order; rows without a key are left out."""
    keyed = data.withColumn("__key", F.upper(key)).where(F.col("__key") != "")
    best = keyed.groupBy("__key").agg(F.max_by(F.struct(*data.columns), "ord").alias("__row"))
    return best.select(F.col("__key").alias("key"), "__row.*")


def first_by_key(data: DataFrame, key: Column) -> DataFrame:
    """One row per upper-cased key, the first in input order."""
    keyed = data.withColumn("__key", F.upper(key)).where(F.col("__key") != "")
    best = keyed.groupBy("__key").agg(F.min_by(F.struct(*data.columns), "ord").alias("__row"))
    return best.select(F.col("__key").alias("key"), "__row.*")


def unique(data: DataFrame, key: str, asked: DataFrame, question: str) -> DataFrame:
    """At most one row per question, case-insensitive: the data set's last with that key."""
    return asked.join(last_by_key(data, F.col(key)), F.upper(question) == F.col("key")).drop("key")


def every(data: DataFrame, key: str, asked: DataFrame, question: str) -> DataFrame:
    """All rows per question, case-insensitive."""
    keyed = data.withColumn("__key", F.upper(F.col(key))).where(F.col("__key") != "")
    return asked.join(keyed, F.upper(question) == F.col("__key")).drop("__key")


def search(
    data: DataFrame,
    text: str,
    fields: Sequence[str],
    sort: Sequence[str],
    where: Column | None = None,
    limit: int | None = SEARCH_LIMIT,
) -> DataFrame:
    """Rows whose fields hold the text, whatever its case, in locale order; empty text finds none."""
    if not text:
        return data.limit(0)
    needle = text.lower()
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.lower(field).contains(needle), F.lit(False))
    rows = data.where(found if where is None else found & where)
    rows = rows.orderBy(*[F.collate(F.coalesce(s, F.lit("")), "UNICODE") for s in sort], "ord")
    return rows if limit is None else rows.limit(limit)


def first_n(rows: DataFrame, per: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key in the given order, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


# fixed values: navaids tuned in MHz; all others are tuned in kHz
MHZ_NAVAIDS = ("VOR", "VORTAC", "VOR/DME", "TACAN", "DME", "VOT")


def by_frequency(navaids: DataFrame, asked: DataFrame, frequency: str = "frequency", limit: int = SEARCH_LIMIT) -> DataFrame:
    """Navaids tuned to exactly each frequency asked, by identifier."""
    tuned = F.when(F.col("type").isin(*MHZ_NAVAIDS), F.col("frequencyMhz")).otherwise(F.col("frequencyKhz"))
    found = asked.join(navaids.withColumn("__tuned", tuned), F.col(frequency) == F.col("__tuned")).drop("__tuned")
    return first_n(found, [frequency], [F.collate("identifier", "UNICODE"), "ord"], limit)


def by_type(data: DataFrame, types: Sequence[str], key: str = "identifier") -> DataFrame:
    return data.where(F.col("type").isin(*types)).orderBy(F.collate(key, "UNICODE"), "ord")


def dataset_status(**tables: DataFrame) -> DataFrame:
    """One row per data set: its name and number of records."""
    parts = [t.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("dataset"), "records") for name, t in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
