"""Airways: ordered waypoints, expanded between two fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_fix(airways: DataFrame, asked: DataFrame, question: str = "ident") -> DataFrame:
    """Every airway and waypoint index with each identifier."""
    points = airways.select("ord", "designation", F.posexplode("waypoints").alias("waypointIndex", "waypoint"))
    keyed = points.withColumn("__key", F.upper("waypoint.identifier")).where(F.col("__key") != "")
    return asked.join(keyed, F.upper(question) == F.col("__key")).drop("__key")


def _slice_between(waypoints: Column, entry: Column, exit_: Column) -> Column:
    """Waypoints from the first entry to the last exit, reversed where the airway runs the other way; else null."""
    idents = F.transform(waypoints, lambda w: F.upper(w["identifier"]))
    first = F.array_position(idents, F.upper(entry))
    back = F.array_position(F.reverse(idents), F.upper(exit_))
    last = F.when(back > 0, F.size(waypoints) + 1 - back).otherwise(0)
    ahead = F.slice(waypoints, first.cast("int"), (last - first + 1).cast("int"))
    behind = F.reverse(F.slice(waypoints, last.cast("int"), (first - last + 1).cast("int")))
    return F.when((first > 0) & (last > 0) & (first < last), ahead).when((first > 0) & (last > 0) & (first > last), behind)


def expand(airways: DataFrame, asked: DataFrame, key: list[str], designation: str = "designation", entry: str = "entryFix", exit_: str = "exitFix") -> DataFrame:
    """The stretch between two fixes for each question: of the first airway of that name that has it.

    Questions whose entry and exit are the same or missing give no row. Waypoints are dealt once, by
    airway name and fix, and meet the questions' ends there; only what has met goes on. Distances to
    the next waypoint stay those of the airway's own direction.
    """
    points = airways.select(F.upper("designation").alias("__name"), "ord", F.posexplode("waypoints").alias("__at", "__w"))
    points = points.select("__name", F.upper("__w.identifier").alias("__fix"), "ord", "__at")
    ends = asked.select(*key, F.upper(designation).alias("__name"), F.upper(entry).alias("__in"), F.upper(exit_).alias("__out"))
    either = ends.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("__enters")).withColumn("__fix", F.when(F.col("__enters"), F.col("__in")).otherwise(F.col("__out")))
    met = points.join(either, ["__name", "__fix"]).groupBy(*key, "__name", "__in", "__out", "ord")
    both = met.agg(F.min(F.when(F.col("__enters"), F.col("__at"))).alias("__from"), F.max(F.when(~F.col("__enters"), F.col("__at"))).alias("__to"))
    chosen = both.where("__from <> __to").groupBy(*key).agg(F.min("ord").alias("ord"))
    met = asked.join(chosen, key).join(airways.select("ord", F.col("designation").alias("airway"), "waypoints"), "ord")
    met = met.withColumn("waypoints", _slice_between(F.col("waypoints"), F.col(entry), F.col(exit_)))
    return met.select(*asked.columns, "ord", "airway", "waypoints")


def split_at_antimeridian(airways: DataFrame) -> DataFrame:
    """Airways as lines that never cross 180 degrees: each crossing ends one line and begins another.

    Returns designation, line number and its points [lon, lat]; a crossing adds the point where the
    latitude, taken linearly in longitude, meets the meridian, on both sides.
    """
    start = F.array().cast("array<array<array<double>>>")

    def point(lon: Column, lat: Column) -> Column:
        return F.array(lon.cast("double"), lat.cast("double"))

    def step(lines: Column, w: Column) -> Column:
        here = point(w["lon"], w["lat"])
        line = F.element_at(lines, -1)
        last = F.element_at(line, -1)
        side = F.when(last[0] >= 0, F.lit(180.0)).otherwise(F.lit(-180.0))
        far = w["lon"] + side * 2
        lat = last[1] + (w["lat"] - last[1]) * F.try_divide(side - last[0], far - last[0])
        rest = F.slice(lines, F.lit(1), F.size(lines) - 1)
        crossed = F.concat(rest, F.array(F.concat(line, F.array(point(side, lat)))), F.array(F.array(point(-side, lat), here)))
        joined = F.concat(rest, F.array(F.concat(line, F.array(here))))
        return F.when(F.size(lines) == 0, F.array(F.array(here))).when(F.abs(w["lon"] - last[0]) > 180, crossed).otherwise(joined)

    lines = F.aggregate("waypoints", start, step)
    return airways.select("designation", F.posexplode(lines).alias("line", "points"))
