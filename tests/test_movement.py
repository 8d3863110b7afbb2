"""Movements of advisories in all their spellings."""

from aerolake.operators.reports import advisories
from pyspark.sql import functions as F

SAID = {
    "TS MOV FROM 24025KT. TOPS": (240, None, 25, None),
    "TS MOVING FROM 24025KT": (240, None, 25, None),
    "TS MOV FROM 240120KT": (240, None, 120, None),
    "TS MOVG FROM 24025KMH": (240, None, None, 25),
    "OBS MOV NE 20KT NC": (None, "NE", 20, None),
    "OBS MOVG TO SSW 35 KMH": (None, "SSW", None, 35),
    "OBS MOV  NE  5 KT": (None, "NE", 5, None),
    "OBS MOV LTL": (None, None, None, None),
    "OBS MOV NE": (None, None, None, None),
    "MOVED NE 20KT": (None, None, None, None),
    "nothing": (None, None, None, None),
}


def test_movement(spark):
    rows = spark.createDataFrame([(t,) for t in SAID] + [(None,)], "t string").select("t", advisories.movement(F.col("t")).alias("m"))
    assert {r.t: tuple(r.m) for r in rows.collect()} == SAID | {None: (None,) * 4}
