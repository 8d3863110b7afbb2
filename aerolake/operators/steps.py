"""Steps of a long computation whose results stay columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, *columns: Column, apart: bool = False) -> DataFrame:
    """`rows` with more columns, each evaluated once for a row however often later steps use it.

    Each is taken out of an array of one, at a place that is always 0 but not deterministic: the optimizer
    neither writes such a column out at its uses nor moves filters below it, and leaves it out where nothing
    uses it.

    A step of very many columns is asked for `apart`: one method for all of them would be too long for the
    JVM to compile, and would run from its bytecode for every row. An array function on the first column,
    which must be one that is used, has Spark evaluate the step column by column.
    """
    made, place = rows.select("*", *columns), F.least(F.spark_partition_id(), F.lit(0))
    names = made.columns[len(rows.columns) :]
    arrays = [F.array(F.col(f"`{n}`")) for n in names]
    if apart:
        arrays[0] = F.transform(arrays[0], lambda x: x)
    return made.select(*[F.col(f"`{n}`") for n in rows.columns], *[F.get(a, place).alias(n) for a, n in zip(arrays, names)])
