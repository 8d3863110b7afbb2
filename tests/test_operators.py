"""Functions and readers on single values that are known."""

import pytest

from aerolake.functions import flight, geo, units
from aerolake.functions.sqlfn import register
from aerolake.operators import airways, routes
from aerolake.operators.reports import advisories, feeds, metar, notam, pirep, taf, winds
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def functions(spark):
    for every, mark in ((units.FUNCTIONS, "units"), (geo.FUNCTIONS, "geo"), (flight.FUNCTIONS, "flight")):
        register(spark, every, mark)


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("distance_nm(40.6413, -73.7781, 33.9416, -118.4085)", pytest.approx(2145.9, abs=1)),
        ("bearing_deg(0D, 0D, 0D, 10D)", pytest.approx(90)),
        ("point_in_polygon(0.5D, 0.5D, array(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D), array(0D, 0D))))", True),
        ("point_in_polygon(1.5D, 0.5D, array(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D), array(0D, 0D))))", False),
        ("size(close_ring(array(array(0D, 0D), array(1D, 0D), array(1D, 1D))))", 4),
        ("size(open_ring(array(array(0D, 0D), array(1D, 0D), array(0D, 0D))))", 2),
        ("nautical_miles_to_kilometers(1D)", 1.852),
        ("celsius_to_fahrenheit(100D)", pytest.approx(212)),
        ("isa_temperature_celsius(36089D)", pytest.approx(-56.5, abs=0.01)),
        ("pressure_at_altitude_hpa(0D)", pytest.approx(1013.25)),
        ("format_altitude(35000D)", "FL350"),
        ("format_altitude(4500D)", "4,500 ft"),
        ("format_distance(12.345D, 'nm')", "12.3 nm"),
        ("format_qnh(29.92D, 'inHg')", "29.92 inHg"),
        ("holding_pattern_entry(90D, 270D)", "parallel"),
        ("holding_pattern_entry(148.4D, 328.4D)", "direct"),
        ("load_factor(60D)", pytest.approx(2)),
        ("cast(airac_date(24, 1) as string)", "2024-01-25"),
        ("is_daytime(40D, -75D, timestamp'2024-06-21 17:00:00')", True),
        ("is_daytime(40D, -75D, timestamp'2024-06-21 06:00:00')", False),
        ("solar_times(51.48D, 0D, date'2024-03-20').sunrise between timestamp'2024-03-20 06:00:00' and timestamp'2024-03-20 06:09:00'", True),
        ("solar_times(80D, 0D, date'2024-06-21').sunrise", None),
        ("try_divide(1D, 0D) is null and fuel_required(1D, 0D, 1D) is null", True),
    ],
)
def test_value(spark, expression, expected):
    assert spark.sql(f"select {expression} as x").first().x == expected


def _read(spark, parse, *texts):
    return parse(spark.createDataFrame([(t,) for t in texts], "raw string")).collect()


def test_observation(spark):
    good, cavok, bad, none = _read(
        spark, metar.parse, "METAR KJFK 121851Z 31015G25KT 280V340 2 1/2SM R04R/3000V6000FT/U -RA BR BKN014 OVC030CB M01/M05 A2992 RMK AO2 SLP132 T10061050 $", "EGLL 121850Z 24010KT CAVOK 15/08 Q1013 NOSIG", "nonsense", None
    )
    assert (good.stationId, good.wind.directionDeg, good.wind.gustKt, good.visibility.visibilitySm) == ("KJFK", 310, 25, 2.5)
    assert (good.windVariableFromDeg, good.temperatureC, good.dewpointC, good.altimeterInHg, good.flightCategory) == (280, -1, -5, 29.92, "IFR" if good.visibility.visibilitySm < 3 else "MVFR")
    assert [x.coverage for x in good.sky.layers] == ["BKN", "OVC"] and good.sky.layers[1].type == "CB"
    assert (good.remarks.seaLevelPressureHpa, good.remarks.preciseTemperatureC, good.remarks.isMaintenanceNeeded) == (1013.2, -0.6, True)
    assert cavok.isCavok and cavok.altimeterHpa == 1013 and cavok.isNoSignificantChange and cavok.flightCategory == "VFR"
    assert bad.error and none.error and not good.error


def test_forecast(spark):
    good, bad = _read(spark, taf.parse, "TAF AMD KJFK 121130Z 1212/1318 31015KT P6SM SCT040 FM121800 28012G20KT 3SM BR OVC008 PROB30 TEMPO 1300/1304 1SM TSRA BKN005CB WS020/25045KT", "TAF?")
    assert good.isAmended and [g.changeType for g in good.forecast] == [None, "FM", "TEMPO"]
    assert good.forecast[2].probability == 30 and good.forecast[1].flightCategory == "IFR"
    assert bad.error


def test_other_reports(spark):
    report = _read(spark, pirep.parse, "KOKC UA /OV OKC063015/TM 1522/FL085/TP C172/SK BKN065-TOP090/WX FV05SM/TA M04/WV 24540/TB LGT/IC NEG/RM SMOOTH")[0]
    assert (report.altitudeFtMsl, report.aircraftType, report.temperatureC, report.windSpeedKt, report.remarks) == (8500, "C172", -4, 40, "SMOOTH")
    assert report.points[0].radialDeg == 63 and report.visibilitySm == 5
    notice = _read(spark, notam.parse, "A0123/24 NOTAMR A0100/24 Q) EGTT/QMRLC/IV/NBO/A/000/999/5129N00028W005 A) EGLL B) 2401011200 C) PERM E) RWY 09L/27R CLSD")[0]
    assert (notice.action, notice.referencedId, notice.isPermanent, notice.qualifier.fir) == ("REPLACE", "A0100/24", True, "EGTT")
    assert notice.qualifier.coordinates.lon == pytest.approx(-28 / 60)
    bulletin = "DATA BASED ON 121200Z\nVALID 121800Z   FOR USE 1400-2100Z. TEMPS NEG ABV 24000\nFT  3000    6000    9000   12000   18000   24000  30000  34000  39000\nBOS 9900 2715+05 2725+00 2730-05 7312-18 731960 801550"
    levels = {r.altitudeFt: r for r in _read(spark, winds.parse, bulletin)}
    assert levels[3000].isLightAndVariable and levels[6000].speedKt == 15 and levels[6000].temperatureC == 5


def test_feeds(spark):
    text = "one\r\n\r\n two \n"
    rows = feeds.split(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, value string"), feeds.lines).collect()
    assert [(r.id, r.raw) for r in rows] == [(1, "one"), (1, "two")]


def test_routes(spark):
    fixes = spark.createDataFrame([(1, "MERIT", 41.4, -73.1), (2, "MARTN", 42.0, -75.0)], "ord long, identifier string, lat double, lon double")
    airports = spark.createDataFrame([(1, "KJFK", "JFK", 40.6, -73.8)], "ord long, icao string, faaId string, lat double, lon double")
    way = "struct<identifier: string, name: string, lat: double, lon: double, distanceToNextNm: double>"
    lanes = spark.sql(f"select 1L as ord, 'J60' as designation, cast(array(struct('MERIT', 'MERIT', 41.4D, -73.1D, 50D), struct('MID', 'MID', 41.7D, -74.0D, 45D), struct('MARTN', 'MARTN', 42D, -75D, 10D)) as array<{way}>) as waypoints")
    text = spark.createDataFrame([(1, "kjfk dct merit J60 martn n0450f350 4130N07320W nowhere"), (2, "  ")], "route_id long, route string")
    resolved = routes.resolve(text, fixes=fixes, airports=airports, airways=lanes)
    kinds = {r.route_id: [e.type for e in r.elements] for r in resolved.collect()}
    assert kinds == {1: ["airport", "direct", "waypoint", "airway", "speedAltitude", "coordinate", "unresolved"], 2: []}
    found = {r.route_id: r for r in routes.route_distance(resolved, ground_speed=F.lit(450.0)).collect()}
    assert found[1].unresolved == ["NOWHERE"] and found[1].legs == 4 and found[2].totalDistanceNm == 0
    asked = spark.createDataFrame([(1, "j60", "martn", "merit")], "id long, designation string, entryFix string, exitFix string")
    back = airways.expand(lanes.withColumnRenamed("designation", "designation"), asked, ["id"]).first()
    assert [w.identifier for w in back.waypoints] == ["MARTN", "MID", "MERIT"]


def test_advisories(spark):
    read = _read(spark, advisories.parse_sigmet, "CONVECTIVE SIGMET 45C\nVALID UNTIL 2055Z\nTX OK\nFROM 30NW OKC-40S TUL-30W DFW-30NW OKC\nAREA SEV TS MOV FROM 26025KT. TOPS ABV FL450.")
    assert len(read) == 1


def test_forecast_groups_are_what_the_reports_list(spark):
    said = ["TAF KJFK 121130Z 1212/1318 31015KT P6SM SCT040 FM121800 28012G20KT 3SM BR OVC008 PROB30 TEMPO 1220/1222 1/2SM FG VV002", "TAF KABC 121130Z 1212/1318 CNL", "no forecast"]
    rows = spark.createDataFrame(list(enumerate(said)), "n int, raw string")
    listed = [(r["n"], i, g.asDict(recursive=True)) for r in taf.parse(rows).orderBy("n").collect() for i, g in enumerate(r["forecast"] or [])]
    found = [r.asDict(recursive=True) for r in taf.forecasts(rows).orderBy("n", "pos").collect()]
    assert [(r.pop("n"), r.pop("pos"), r) for r in found] == listed and len(listed) == 3
