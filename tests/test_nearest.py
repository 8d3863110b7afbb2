"""The nearest rows where rows lie densely, at one point, around a pole and over the 180th meridian."""

import math
import random

import pytest

from aerolake.operators import spatial


def _miles(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 3440.065 * math.asin(math.sqrt(min(h, 1)))


def _joined(plan) -> int:
    """Most rows that a join of the plan, as executed, gave."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _joined(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _joined(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *(_joined(below.apply(i)) for i in range(below.size()))])


def _places(kind):
    rng = random.Random(7)
    if kind == "dense":
        return [(40 + rng.random() / 2, -90 + rng.random() / 2) for _ in range(1500)]
    if kind == "one point":
        return [(40.0, -90.0)] * 1000 + [(40 + rng.random(), -90 + rng.random()) for _ in range(300)]
    if kind == "pole":
        return [(90 - rng.random() ** 2 / 5, rng.uniform(-180, 180)) for _ in range(600)]
    return [(rng.uniform(-0.3, 0.3), (180 + rng.uniform(-0.3, 0.3) + 180) % 360 - 180) for _ in range(600)]


@pytest.mark.parametrize("kind", ["dense", "one point", "pole", "meridian"])
def test_nearest(spark, kind):
    rows, asked = _places(kind), _places(kind)[::3]
    data = spark.createDataFrame([(n, *p) for n, p in enumerate(rows)], "ord int, lat double, lon double")
    questions = spark.createDataFrame([(n, *p) for n, p in enumerate(asked)], "q int, lat double, lon double")
    found = spatial.nearest(data, questions, ["q"], 60.0, 4).select("q", "rank", "ord", "distanceNm")
    got = sorted(map(tuple, found.collect()))
    best = []
    for q, (lat, lon) in enumerate(asked):
        near = sorted((math.floor(d * 100 + 0.5) / 100, n) for n, p in enumerate(rows) if (d := _miles(lat, lon, *p)) <= 60)
        best += [(q, rank + 1, n, d) for rank, (d, n) in enumerate(near[:4])]
    assert [g[:3] for g in got] == [b[:3] for b in best]
    assert max(abs(g[3] - b[3]) for g, b in zip(got, best)) < 0.011
    if kind != "pole":  # there cells of degrees are slivers, and every question looks all around
        assert _joined(found._jdf.queryExecution().executedPlan()) < len(rows) * len(asked) / 4
