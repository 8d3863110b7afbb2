"""Departures, arrivals and approaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import last_by_key


def airport_bridge(procedures: DataFrame) -> DataFrame:
    """One row per procedure and airport, the airport upper-cased."""
    return procedures.withColumn("airport", F.explode("airports")).withColumn("airport", F.upper("airport"))


def by_airport(procedures: DataFrame, asked: DataFrame, question: str = "airportId") -> DataFrame:
    return asked.join(airport_bridge(procedures), F.upper(question) == F.col("airport"))


def by_airport_and_identifier(procedures: DataFrame, asked: DataFrame, airport: str = "airportId", ident: str = "ident") -> DataFrame:
    """At most one procedure per question: the last with that airport and identifier."""
    keyed = last_by_key(airport_bridge(procedures), F.concat_ws("::", "airport", "identifier"))
    return asked.join(keyed, F.upper(F.concat_ws("::", airport, ident)) == F.col("key")).drop("key")


def by_airport_and_runway(procedures: DataFrame, asked: DataFrame, airport: str = "airportId", runway: str = "rwy") -> DataFrame:
    """Procedures of the airport for the runway, or with a transition named RW and the runway."""
    met = by_airport(procedures, asked, airport)
    named = F.concat(F.lit("RW"), F.upper(runway))
    return met.where(F.coalesce(F.upper("runway") == F.upper(runway), F.lit(False)) | F.exists("transitions", lambda t: F.upper(t["name"]) == named))


def by_type(procedures: DataFrame, kind: str) -> DataFrame:
    """SID, STAR, or for any other name everything that is neither."""
    return procedures.where(F.col("type") == kind if kind in ("SID", "STAR") else ~F.col("type").isin("SID", "STAR"))


def by_approach_type(procedures: DataFrame, approach: str) -> DataFrame:
    """Approaches of one type of guidance."""
    return procedures.where(F.col("approachType") == approach)


def _join_segments(first: Column, second: Column) -> Column:
    """Both in order; a connecting fix that repeats counts once."""
    repeated = F.upper(F.element_at(first, -1)["fixIdentifier"]) == F.upper(second[0]["fixIdentifier"])
    return F.concat(first, F.when(F.coalesce(repeated, F.lit(False)), F.slice(second, F.lit(2), F.greatest(F.size(second) - 1, F.lit(0)))).otherwise(second))


def merged_legs(kind: Column, name: Column, transition: Column, common: Column) -> Column:
    """Legs of a transition and the common route: which comes first follows from the kind of both."""
    runway = F.upper(name).startswith("RW")
    first = F.when(kind == "SID", runway).when(kind == "STAR", ~runway).otherwise(True)
    both = F.when(first, _join_segments(transition, common)).otherwise(_join_segments(common, transition))
    return F.when(F.size(transition) == 0, common).when(F.size(common) == 0, transition).otherwise(both)


def expand(procedures: DataFrame, asked: DataFrame, airport: str = "airportId", ident: str = "ident", transition: str = "transitionName") -> DataFrame:
    """Ordered legs of each question's procedure, through a named transition where one is given.

    No row where procedure, route or transition is missing.
    """
    met = by_airport_and_identifier(procedures, asked, airport, ident)
    wanted = F.filter("transitions", lambda t: F.upper(t["name"]) == F.upper(transition))
    met = met.withColumn("__t", F.get(wanted, F.lit(0))).withColumn("__c", F.get("commonRoutes", F.lit(0)))
    legs = (
        F.when(F.col(transition).isNull(), F.col("__c.legs"))
        .when(F.col("__t").isNull(), None)
        .when(F.col("__c").isNull(), F.col("__t.legs"))
        .otherwise(merged_legs(F.col("type"), F.col("__t.name"), F.col("__t.legs"), F.col("__c.legs")))
    )
    return met.withColumn("legs", legs).where(F.col("legs").isNotNull()).drop("__t", "__c")


def count_legs(procedures: DataFrame) -> DataFrame:
    """Number of legs per procedure over common routes, transitions and missed approach."""

    def total(parts: str) -> Column:
        return F.aggregate(F.transform(parts, lambda p: F.size(p["legs"])), F.lit(0), lambda a, b: a + b)

    missed = F.coalesce(F.size("missedApproach.legs"), F.lit(0))
    return procedures.select("ord", "identifier", (total("commonRoutes") + total("transitions") + F.greatest(missed, F.lit(0))).alias("legs"))
