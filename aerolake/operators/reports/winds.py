"""Winds and temperatures aloft: bulletins of fixed columns to one row per station and level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c


def decode(entry: Column, altitude_ft: Column, negative_above_ft: Column) -> Column:
    """Direction, speed and temperature of an entry such as 2731-12, 731960 or 9900.

    Direction codes 51 to 86 stand for directions less 50 and speeds over 100 knots; unsigned
    temperatures are below zero above the given altitude.
    """
    e = F.trim(entry)
    where, speed = c.number(F.substring(e, 1, 2)), c.number(F.substring(e, 3, 2))
    rest = F.regexp_extract(e, r"^\d{4}([+-]?\d+)$", 1)
    degrees = c.number(rest)
    light = (where == 99) & (speed == 0)
    fast, plain = where.between(51, 86), where.between(1, 36)
    bad = (e != "") & (~e.rlike(r"^\d{4}([+-]?\d+)?$") | ~(light | fast | plain))
    return F.struct(
        (e == "").alias("isMissing"),
        F.coalesce(light, F.lit(False)).alias("isLightAndVariable"),
        F.when(fast, (where - 50) * 10).when(plain, where * 10).alias("directionDeg"),
        F.when(fast, speed + 100).when(plain, speed).alias("speedKt"),
        F.when(rest.rlike("^[+-]"), degrees).when(altitude_ft > negative_above_ft, -degrees).otherwise(degrees).alias("temperatureC"),
        F.when(bad, F.lit("entry cannot be read")).alias("error"),
    )


def parse(bulletins: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per station and level; a bulletin without its header rows gives one row with `error`."""
    rest = [x for x in bulletins.columns if x != raw]
    lines = F.split(F.col(raw), r"\r?\n")
    rows = bulletins.withColumn("lines", lines)
    rows = rows.withColumn("header", F.get(F.filter("lines", lambda x: x.rlike(r"^FT\s")), F.lit(0)))
    rows = rows.withColumn("valid", F.get(F.filter("lines", lambda x: F.trim(x).rlike(r"^VALID \d{6}Z")), F.lit(0)))
    rows = rows.withColumn("based", c.found(F.col(raw), r"DATA BASED ON (\d{6})Z"))
    rows = rows.withColumn("negative", c.number(c.found(F.col("valid"), r"TEMPS NEG ABV (\d+)")))
    # a column ends where its altitude does and begins two places after the one before
    altitudes = F.regexp_extract_all("header", F.lit(r"(\d+)"), F.lit(1))
    prefixes = F.transform(F.split("header", r"(?<=\d)(?=\s|$)"), lambda p: F.length(p))
    rows = rows.withColumn("altitudes", altitudes).withColumn("widths", prefixes)
    ends = F.transform("altitudes", lambda a, i: F.aggregate(F.slice("widths", F.lit(1), i + 1), F.lit(0), lambda x, y: x + y))
    rows = rows.withColumn("ends", ends)
    body = F.filter("lines", lambda x: x.rlike(r"^[A-Z0-9]{3}\s") & ~x.rlike(r"^(FT|VALID|DATA)\b"))
    each = rows.withColumn("line", F.explode(body)).withColumn("level", F.explode(F.sequence(F.lit(0), F.size("altitudes") - 1)))
    start = F.when(F.col("level") == 0, F.lit(5)).otherwise(F.get("ends", F.col("level") - 1) + 2)
    end = F.get("ends", F.col("level"))
    altitude = c.number(F.get("altitudes", F.col("level")))
    entry = F.substr("line", start, F.greatest(end - start + 1, F.lit(0)))
    use = r"FOR USE (\d{4})-(\d{4})Z"
    good = each.where(F.col("negative").isNotNull() & F.col("header").isNotNull()).select(
        *rest,
        c.day_time_of(F.col("based")).alias("basedOn"),
        c.day_time_of(c.found(F.col("valid"), r"VALID (\d{6})Z")).alias("validAt"),
        c.day_time_of(c.found(F.col("valid"), use, 1)).alias("useFrom"),
        c.day_time_of(c.found(F.col("valid"), use, 2)).alias("useTo"),
        F.trim(F.substring("line", 1, 3)).alias("stationId"),
        altitude.alias("altitudeFt"),
        decode(entry, altitude, F.col("negative")).alias("w"),
    )
    return good.select(*[x for x in good.columns if x != "w"], "w.*")


def level_at(levels: DataFrame, altitude_ft: int) -> DataFrame:
    return levels.where(F.col("altitudeFt") == altitude_ft)
