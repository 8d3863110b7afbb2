"""SQL-bodied functions: Catalyst inlines each call, so formulas stay in whole-stage code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SqlFunction:
    """A temporary function. Parameters are "name type" strings, DOUBLE where no type is given."""

    name: str
    params: tuple[str, ...]
    body: str
    returns: str = "DOUBLE"

    def ddl(self) -> str:
        params = ", ".join(p if " " in p else f"{p} DOUBLE" for p in self.params)
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({params}) RETURNS {self.returns} RETURN {self.body}"

    def __call__(self, *args: Column | str | float) -> Column:
        return F.call_function(self.name, *(a if isinstance(a, (Column, str)) else F.lit(a) for a in args))


def fn(name: str, params: str, body: str, returns: str = "DOUBLE") -> SqlFunction:
    return SqlFunction(name, tuple(p.strip() for p in params.split(",") if p.strip()), body, returns)


def register(spark: SparkSession, functions: list[SqlFunction], mark: str) -> None:
    """Define the functions in the session, once for each mark."""
    key = f"aerolake.functions.{mark}"
    if spark.conf.get(key, None) is None:
        for function in functions:
            spark.sql(function.ddl())
        spark.conf.set(key, "defined")
