"""Builders, readers and ring operations on small inputs that the tables don't hold."""

import gzip
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake.functions import magnetic, rings
from aerolake.operators.builders import airspace, airways, procedures
from aerolake.operators.reports import advisories, notam, pirep
from aerolake.sources import snapshots, text


def test_csv_and_lines(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text('﻿"ID", NAME ,NOTE\n1,"A, B ","say ""x"""\n2, ,\n')
    rows = text.csv(spark, str(file)).orderBy("ord").collect()
    assert [(r.ID, r.NAME, r.NOTE) for r in rows] == [("1", "A, B", 'say "x"'), ("2", None, None)]
    file.write_text('N-NUMBER,NAME\n7,"odd\n')
    assert [(r["N-NUMBER"], r.NAME) for r in text.csv(spark, str(file), quoted=False).collect()] == [("7", '"odd')]
    file.write_text("one\r\n\r\ntwo\n")
    assert [r.value for r in text.lines(spark, str(file)).orderBy("ord").collect()] == ["one", "two"]


def test_numbers_that_texts_begin_with(spark):
    given = spark.createDataFrame([(x,) for x in ("12", " 12.5 ft", "-3x", "abc", "", None, "1e3")], "t string")
    found = given.select(text.number(F.col("t")), text.whole(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(12.0, 12), (12.5, 12), (-3.0, -3), (None, None), (None, None), (None, None), (1000.0, 1)]


def test_snapshots(spark, tmp_path):
    file = tmp_path / "a.json.gz"
    with gzip.open(file, "wt") as out:
        json.dump({"meta": {"recordCount": 2}, "records": [{"id": "A", "lat": 1.5}, {"id": "B", "lat": None}]}, out)
    assert [(r.ord, r.id, r.lat) for r in snapshots.read(spark, str(file)).collect()] == [(0, "A", 1.5), (1, "B", None)]
    assert snapshots.read(spark, str(file), "id string").columns == ["ord", "id"]
    assert snapshots.meta(spark, str(file)).first().recordCount == 2
    area = {"type": "Feature", "properties": {"identifier": "X"}, "geometry": {"type": "Polygon", "coordinates": [[[0.1234567, 0.0], [1.0, 0.0], [1.0, 1.0], [0.1234567, 0.0]]]}}
    file = tmp_path / "b.json"
    file.write_text(json.dumps({"type": "FeatureCollection", "features": [area]}))
    areas = snapshots.features(spark, str(file))
    snapshots.write_features(areas, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.geometry.coordinates[0][0] == [0.12346, 0.0] and back.properties.identifier == "X"


def test_rings():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    assert rings.cut(square) == [square] and rings.cut(square[:3]) == []
    over = [(179.0, 0.0), (-179.0, 0.0), (-179.0, 1.0), (179.0, 1.0), (179.0, 0.0)]
    west, east = rings.cut(over)
    assert {p[0] for p in west} == {179.0, 180.0} and {p[0] for p in east} == {-180.0, -179.0}
    rng = random.Random(1)
    wave = [(x / 50, math.sin(x / 50) + rng.uniform(-1e-4, 1e-4)) for x in range(300)]
    kept = rings.simplified([*wave, wave[0]], 0.01)
    assert 4 <= len(kept) < 60 and kept[0] == kept[-1]
    for x, y in wave:
        ends = [(a, b) for a, b in zip(kept, kept[1:]) if min(a[0], b[0]) <= x <= max(a[0], b[0])]
        assert min(abs(a[1] + (b[1] - a[1]) * (x - a[0]) / ((b[0] - a[0]) or 1) - y) for a, b in ends) < 0.02


def test_ring_functions_of_missing_rings(spark):
    rows = spark.createDataFrame([(None,), ([[0.0, 0.0], [1.0, 1.0]],)], "r array<array<double>>")
    assert [r[0] for r in rows.select(rings.split_antimeridian("r")).collect()] == [[], []]
    assert rows.select(rings.simplify_ring("r", F.lit(0.1))).collect()[0][0] is None


def test_magnetic_field_is_the_gradient_of_its_potential(spark):
    """North, east and down of a random model against differences of its potential on a sphere."""
    rng = np.random.default_rng(2)
    rows = [(n, m, *rng.normal(0, 1000 / n**2, 2), *rng.normal(0, 5, 2)) for n in range(1, 13) for m in range(n + 1)]

    def potential(r, theta, phi, year):
        p, _ = magnetic._legendre(12, theta)
        return sum(magnetic.SPHERE_KM * (magnetic.SPHERE_KM / r) ** (n + 1) * ((g + gy * year) * np.cos(m * phi) + (h + hy * year) * np.sin(m * phi)) * p[n, m] for n, m, g, h, gy, hy in rows)

    points = [(12.0, 34.0, 30000.0, 2026.5), (-71.0, -120.0, 0.0, 2025.0), (48.5, 2.2, 1000.0, 2029.0)]
    df = spark.createDataFrame(points, "lat double, lon double, ft double, year double")
    found = magnetic.with_field(df, 2025.0, rows, altitude_ft="ft", year="year").collect()
    for r in found:
        radius, theta, tilt = magnetic._spherical(np.radians(np.array([r.lat])), np.array([r.ft * magnetic.KM_PER_FT]))
        phi, year, e = np.radians(r.lon), r.year - 2025, 1e-5
        out = -(potential(radius + 0.01, theta, phi, year) - potential(radius - 0.01, theta, phi, year)) / 0.02
        south = -(potential(radius, theta + e, phi, year) - potential(radius, theta - e, phi, year)) / (2 * e * radius)
        east = -(potential(radius, theta, phi + e, year) - potential(radius, theta, phi - e, year)) / (2 * e * radius * np.sin(theta))
        north = -south * np.cos(tilt) - out * np.sin(tilt)
        down = south * np.sin(tilt) - out * np.cos(tilt)
        assert (r.field.northIntensityNt, r.field.eastIntensityNt, r.field.downIntensityNt) == pytest.approx((north[0], east[0], down[0]), rel=1e-5, abs=1e-2)


def test_coefficient_file(spark, tmp_path):
    file = tmp_path / "m.cof"
    file.write_text("    2025.0            MODEL     11/13/2024\n  1  0  -29351.8       0.0       12.0        0.0\n9999999\n")
    assert magnetic.coefficients(spark, str(file)) == (2025.0, [(1, 0, -29351.8, 0.0, 12.0, 0.0)])


def test_builders_of_nothing(spark):
    lines = spark.createDataFrame([], "ord long, value string")
    assert airways.federal(lines).count() == 0 and airways.oceanic(lines).count() == 0 and procedures.build(lines).count() == 0


def test_approach_names(spark):
    rows = spark.createDataFrame([("IAP", "I04L", "I"), ("IAP", "VOR-A", "V"), ("IAP", "R22-Z", "R"), ("SID", "DEEZZ5", None)], "t string, i string, r string")
    named = rows.select(procedures._name(F.col("t"), F.col("i"), procedures.approach_type(F.col("r")))).collect()
    assert [r[0] for r in named] == ["ILS RWY 04L", "VOR-A", "RNAV RWY 22", "DEEZZ5"]


def test_largest_polygon(spark):
    rows = spark.sql("select array(array(array(1, 2, 3)), array(array(1, 2, 3, 4)), array(array(5, 6, 7, 8))) as p")
    assert rows.select(airspace.largest_polygon(F.col("p"))).first()[0] == [[1, 2, 3, 4]]


def test_reports_written_tightly(spark):
    def read(parse, raw):
        return parse(spark.createDataFrame([(raw,)], "raw string")).first()

    report = read(pirep.parse, "KOKC UA /OVOKC063015/TM1530/FL085/TPC172/TAM04/TB LGT")
    assert (report.aircraftType, report.temperatureC, report.time.hour, report.altitudeFtMsl) == ("C172", -4, 15, 8500)
    warning = read(advisories.parse_sigmet, "WSPA07 PHFO 010337 SIGPAT KZAK SIGMET TANGO 1 VALID 010340/010740 PHFO- OAKLAND OCEANIC FIR EMBD TS FCST WI N1000 E15000")
    assert (warning.firCode, warning.firName) == ("KZAK", "OAKLAND OCEANIC FIR")
    notice = read(notam.parse, "B0007/25 NOTAMC B0001/25 Q) KZNY/QMRLC/IV/NBO/A/000/999/4038N07346W005 A) KJFK KLGA B) 2501011200 C) 2501021200 EST E) SEE PLATE A) AND B) F) SFC G) FL100")
    assert (notice.action, notice.referencedId, notice.locationCodes, notice.isEstimatedEnd) == ("CANCEL", "B0001/25", ["KJFK", "KLGA"], True)
    assert (notice.text, notice.lowerLimit, notice.upperLimit, notice.qualifier.radiusNm) == ("SEE PLATE A) AND B)", "SFC", "FL100", 5)
    domestic = read(notam.parse_domestic, "!FDC 4/3998 DNV IAP VERMILION REGIONAL, DANVILLE, IL. ILS RWY 21 AMDT 7A CHANGE 2404081936-2604081936EST")
    assert (domestic.isFdc, domestic.number, domestic.keyword, domestic.airportName, domestic.isEstimatedEnd) == (True, "4/3998", "IAP", "VERMILION REGIONAL", True)
    assert domestic.text == "ILS RWY 21 AMDT 7A CHANGE" and domestic.effectiveUntil.year == 26
    assert read(notam.parse_domestic, "nothing").error and read(notam.parse_domestic, "").error
