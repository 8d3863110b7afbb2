"""Steps whose columns are evaluated once, and not at all where nothing uses them."""

import pytest
from pyspark.sql import functions as F

from aerolake import plans
from aerolake.operators.builders import procedures
from aerolake.operators.steps import settled
from aerolake.sources import text

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_columns_of_a_step_go(spark):
    rows = settled(spark.range(5), F.sha2(F.col("id").cast("string"), 256).alias("a"), (F.col("id") * 2).alias("b"))
    assert [tuple(r) for r in rows.select("id", "b").orderBy("id").collect()] == [(n, 2 * n) for n in range(5)]
    assert "sha2" not in _plan(rows.select("id", "b"))


def test_a_step_is_evaluated_once(spark):
    rows = settled(spark.range(5), F.sha2(F.col("id").cast("string"), 256).alias("a"))
    used = rows.where("a > '0'").select(F.concat("a", "a").alias("c"), F.upper("a").alias("d"))
    assert _plan(used).count("sha2") == 1


@pytest.mark.parametrize("name", ["procedure_by_identifier", "procedure_search", "procedure_by_airport", "procedure_by_airport_and_identifier"])
def test_lookups_gather_no_legs(spark, name):
    plan = _plan(plans.QUERIES[name](spark, SMALL))
    assert "collect_list" not in plan and "LeftOuter" not in plan


def test_expanded_legs_look_up_no_positions(spark):
    assert "LeftOuter" not in _plan(plans.QUERIES["procedure_expand"](spark, SMALL))


@pytest.mark.parametrize("name", ["procedure_by_runway", "procedure_legs"])
def test_legs_that_are_not_returned_are_not_read(spark, name):
    plan = _plan(plans.QUERIES[name](spark, SMALL))
    assert "collect_list" in plan and "LeftOuter" not in plan and "rnpNm" not in plan


def test_freezing_levels_read_no_areas(spark):
    assert "SUSTAINED SURFACE WIND" not in _plan(plans.QUERIES["airmet_freezing_levels"](spark, SMALL))


def test_kinds_and_fields(spark):
    lines = spark.createDataFrame([(1, "SUSAP KJFKK6DSID1  4TR1   010FIX1 K6EA0".ljust(47) + "IF".ljust(85))], "ord long, value string")
    whole = procedures.build(lines, fields=["fixIdentifier", "seq"]).collect()
    assert [(r["type"], [tuple(g) for g in r["transitions"][0]["legs"]]) for r in whole] == [("SID", [("FIX1",)])]
    assert procedures.build(lines, kinds=["STAR", "IAP"]).count() == 0


@pytest.mark.parametrize(
    "name, unused",
    [("sigmet_international", "SEV DUST/SANDSTORM"), ("sigmet_convective", "SEV DUST/SANDSTORM"), ("taf_groups", "^WS("), ("metar_remark_groups", "PRESRR")],
)
def test_queries_read_only_what_they_return(spark, name, unused):
    assert unused not in _plan(plans.QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["airmet_wind_shear", "airmet_hazards", "airmet_outlooks"])
def test_sections_are_rows_before_they_are_read(spark, name):
    above = _plan(plans.QUERIES[name](spark, SMALL)).split("Generate posexplode")
    assert len(above) == 2 and "transform(" not in above[0].replace("transform(split(", "")


def test_a_field_of_a_pilot_report_is_looked_up_once(spark):
    assert _plan(plans.QUERIES["pirep_tight"](spark, SMALL)).count("[OV]") <= 2


def test_legs_are_read_behind_the_join_and_column_by_column(spark):
    lines = spark.createDataFrame([(1, "x" * 132)], "ord long, value string")
    plan = _plan(procedures.build(lines))
    assert "regexp_extract" in plan and "regexp_extract" not in plan.split("Join LeftOuter")[1]
    read = procedures._legs(spark.range(1).selectExpr("id as ord", "repeat(' ', 132) as value", "'SID' as type"))
    steps = [x for x in read._jdf.queryExecution().executedPlan().toString().split("\n") if "Project" in x and "AS rnpNm" in x]
    assert steps and not any("*(" in x for x in steps)


def test_legs_without_fields_are_counted(spark):
    value = "SUSAP KJFKK6DSID1  4TR1   0{}0FIX1 K6EA0"
    lines = spark.createDataFrame([(n, value.format(n).ljust(47) + "IF".ljust(85)) for n in (1, 2)], "ord long, value string")
    found = procedures.build(lines, fields=[]).collect()
    assert [(r["identifier"], r["transitions"][0]["name"], len(r["transitions"][0]["legs"])) for r in found] == [("SID1", "TR1", 2)]


def test_whole_numbers_of_blank_texts_cast_nothing(spark):
    texts = [("   ", None), ("\t12", 12), ("+5 ", 5), ("7.9", 7), ("99999999999", None), ("--1", None), (" -08x", -8)]
    rows = spark.createDataFrame(texts, "t string, n int")
    assert rows.where(~text.whole(F.col("t")).eqNullSafe(F.col("n"))).count() == 0
    assert "cast(t" not in _plan(rows.select(text.whole(F.col("t"))))
