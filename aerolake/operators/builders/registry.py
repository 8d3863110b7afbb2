"""The aircraft registry: master rows joined with the table of makes and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...sources.text import code, given, whole
from ..lookup import unique

# Published codes.
AIRCRAFT = {
    "1": "glider", "2": "balloon", "3": "blimpOrDirigible", "4": "fixedWingSingleEngine", "5": "fixedWingMultiEngine", "6": "rotorcraft", "7": "weightShiftControl",
    "8": "poweredParachute", "9": "gyroplane", "H": "hybridLift",
}
ENGINES = {
    "0": "none", "1": "reciprocating", "2": "turboProp", "3": "turboShaft", "4": "turboJet", "5": "turboFan", "6": "ramjet", "7": "twoCycle", "8": "fourCycle", "9": "unknown",
    "10": "electric", "11": "rotary",
}


def master(table: DataFrame) -> DataFrame:
    """Rows with a hexadecimal address and a number: registration, icaoHex, operator, year, codes."""
    columns = {"operator": "NAME", "code": "MFR MDL CODE", "aircraftCode": "TYPE AIRCRAFT", "engineCode": "TYPE ENGINE"}
    read = table.select(
        "ord", F.upper(given(F.col("`MODE S CODE HEX`"))).alias("icaoHex"), F.concat(F.lit("N"), given(F.col("`N-NUMBER`"))).alias("registration"),
        whole(F.col("`YEAR MFR`")).alias("yearManufactured"), *[given(F.col(f"`{c}`")).alias(n) for n, c in columns.items()],
    )
    return read.where("icaoHex is not null and registration is not null")


def models(table: DataFrame) -> DataFrame:
    """(code, make, model), the last row of a code."""
    read = table.select("ord", given(F.col("CODE")).alias("code"), given(F.col("MFR")).alias("make"), given(F.col("MODEL")).alias("model")).where("code is not null")
    return read.groupBy("code").agg(F.max_by(F.struct("make", "model"), "ord").alias("m")).select("code", "m.*")


def build(table: DataFrame, reference: DataFrame) -> DataFrame:
    """Registrations with make and model where the reference has their code."""
    joined = master(table).join(models(reference), "code", "left")
    return joined.select(
        "ord", "icaoHex", "registration", "make", "model", "operator", code(F.col("aircraftCode"), AIRCRAFT).alias("aircraftType"),
        code(F.col("engineCode"), ENGINES).alias("engineType"), "yearManufactured",
    )


def by_hex(registry: DataFrame, asked: DataFrame, question: str = "icaoHex") -> DataFrame:
    """At most one registration per question, whatever the case of its letters."""
    return unique(registry.withColumnRenamed("icaoHex", "address"), "address", asked, question)
