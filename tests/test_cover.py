"""Adaptive covers against the test of the whole area."""

import random

import pytest
from pyspark.sql import functions as F

from aerolake.operators import cover


def _star(rng, lon, lat, radius, corners, least=0.5):
    """A ring around a point, closed: square directions, uneven radii."""
    out = []
    for i in range(corners):
        side, t = i * 4 // corners, (i * 8 / corners) % 2 - 1
        u, v = [(t, -1), (1, t), (-t, 1), (-1, -t)][side]
        r = radius * rng.uniform(least, 1)
        out.append([lon + u * r, lat + v * r])
    return out + out[:1]


@pytest.fixture(scope="module")
def areas(spark):
    rng = random.Random(7)
    rows = [(i, [_star(rng, rng.uniform(-110, -80), rng.uniform(28, 44), *x)]) for i, x in enumerate([(12, 400, 0.9), (6, 64), (0.3, 8), (0.004, 5), (3, 200)])]
    rows[1][1].append(_star(rng, rows[1][1][0][0][0] + 3, rows[1][1][0][0][1] + 3, 0.5, 16))  # a hole
    rows += [(10, [[[-100.0, 30.0], [-90.0, 30.0], [-90.0, 40.0], [-100.0, 40.0], [-100.0, 30.0]]]), (11, []), (12, None), (13, [[[-95.0, 35.0]]])]
    return spark.createDataFrame(rows, "area int, boundary array<array<array<double>>>")


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(-125, -65), rng.uniform(15, 55)) for i in range(4000)] + [(4000 + i, -100.0 + i, 30.0 + i) for i in range(11)] + [(5000, None, 30.0)]
    return spark.createDataFrame(rows, "point int, lon double, lat double")


def _inside(rings, x, y):
    odd = False
    for ring in rings:
        for (px, py), (qx, qy) in zip(ring, ring[-1:] + ring[:-1]):
            if (y < py) != (y < qy) and x < (qx - px) * (y - py) / (qy - py) + px:
                odd = not odd
    return odd


def _brute(areas, points):
    rows = [r for r in areas.collect() if r["boundary"]]
    return {(p["point"], a["area"]) for p in points.where("lon is not null").collect() for a in rows if _inside(a["boundary"], p["lon"], p["lat"])}


@pytest.mark.parametrize("few", [0, 8])
def test_equal_to_the_whole_test(areas, points, few):
    found = [tuple(r) for r in cover.holding(cover.cover(areas, few_edges=few), points).select("point", "area").collect()]
    assert len(found) == len(set(found)) > 500
    assert set(found) == _brute(areas, points)


def test_cover_is_small_and_mostly_without_test(areas, points):
    cells = {r["area"]: r for r in cover.cover(areas).groupBy("area").agg(F.count("*").alias("n"), F.max(F.size("__edges")).alias("edges"), F.sum(F.col("__inner").cast("int")).alias("inner")).collect()}
    assert set(cells) == {0, 1, 2, 3, 4, 10, 13}
    assert cells[0]["n"] <= 1000 and cells[0]["inner"] >= 10 and cells[0]["edges"] < 200
    assert cells[10]["n"] <= 16
    met = cover.cover(areas.where("area = 0"))
    asked = points.where("lon is not null")
    at = F.array(*[F.struct(F.lit(n).alias("__level"), F.floor(F.col("lon") / (8.0 / 2**n)).alias("__x"), F.floor(F.col("lat") / (8.0 / 2**n)).alias("__y")) for n in range(8)])
    share = asked.select(F.inline(at)).join(met, ["__level", "__x", "__y"]).agg(F.avg(F.col("__inner").cast("int"))).first()[0]
    assert share > 0.5


def test_first_and_none(areas, points):
    rows = cover.first_holding(cover.cover(areas), points, ["point"], ["area"], ["area"]).collect()
    best = {}
    for point, area in _brute(areas, points):
        best[point] = min(area, best.get(point, area))
    assert len(rows) == 4012 and {r["point"]: r["area"] for r in rows if r["area"] is not None} == best


def test_plan_has_no_nested_loop(areas, points):
    plan = cover.holding(cover.cover(areas), points)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(areas, points):
    assert cover.holding(cover.cover(areas.limit(0)), points).count() == 0
    assert cover.holding(cover.cover(areas), points.limit(0)).count() == 0


def test_airports_get_their_time_zones(spark):
    from aerolake.operators.builders import places

    built = spark.createDataFrame([("AAA", 35.0, -95.0), ("BBB", 35.0, -85.0), ("CCC", 0.0, 0.0), ("DDD", None, None)], "faaId string, lat double, lon double")
    west = [[[-100.0, 30.0], [-90.0, 30.0], [-90.0, 40.0], [-100.0, 40.0], [-100.0, 30.0]]]
    east = [[[-90.0, 30.0], [-80.0, 30.0], [-80.0, 40.0], [-90.0, 40.0], [-90.0, 30.0]]]
    zones = spark.createDataFrame([("America/West", west), ("America/East", east), ("Zulu/Over", west)], "tzid string, boundary array<array<array<double>>>")
    assert {r["faaId"]: r["timezone"] for r in places.with_time_zones(built, zones).collect()} == {"AAA": "America/West", "BBB": "America/East", "CCC": None, "DDD": None}
