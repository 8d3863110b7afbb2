"""Plain-language remark groups, one observation each."""

import pytest
from aerolake.operators.reports import metar

HEAD = "METAR KABC 011251Z 00000KT 10SM CLR 10/05 A3000"


@pytest.fixture(scope="module")
def said(spark):
    def read(*remarks):
        rows = [(n, f"{HEAD} RMK {r}" if r is not None else HEAD) for n, r in enumerate(remarks)]
        found = metar.parse(spark.createDataFrame(rows, "n int, raw string")).select("n", "remarks").collect()
        return [r.remarks for r in sorted(found)]

    return read


def plain(rows):
    return [tuple(r) for r in rows]


def test_groups_end_where_their_words_end(said):
    a, b, c, d, e = said(
        "AO2 TS SW MOV NE SLP132", "VIS 1/4V2 CB DSNT W TCU OHD-N X", "OCNL LTGICCGCAX VC AND N TS", "LTG DSNT ALQDS VIRGA SE-S MOV", "TS",
    )
    assert plain(a.thunderstorms) == [("SW", "NE")] and a.seaLevelPressureHpa == pytest.approx(1013.2)
    assert tuple(b.variableVisibility) == (0.25, 2.0) and plain(b.significantClouds) == [("CB", "DSNT W"), ("TCU", None)]
    assert plain(c.lightning) == [("OCNL", ["IC", "CG", "CA"], "VC AND N")] and c.thunderstorms == []
    assert plain(d.lightning) == [(None, [], "DSNT")] and plain(d.virga) == [("SE-S",)]
    assert e.thunderstorms == []


def test_values(said):
    a, b, c, d = said("TWR VIS 2 SFC VIS 3/4 VIS 1 1/2 RWY06L VIS N2", "GR 2 GR 1/2 CIG 002V008 CIG 017 RWY11", "GR LESS THAN 1/4 SNINCR 1/12", "VIS FOO CIG 01 GR GS SNINCR X")
    assert plain(a.towerSurfaceVisibility) == [("TWR", 2.0), ("SFC", 0.75)]
    assert plain(a.secondLocationVisibility) == [(1.5, "RWY06L")] and plain(a.sectorVisibility) == [("N", 2.0)]
    assert b.hailSizeIn == 0.5 and plain(b.secondLocationCeiling) == [(1700, "RWY11")] and (b.variableCeilingMinFt, b.variableCeilingMaxFt) == (200, 800)
    assert c.hailSizeIn == 0.25 and tuple(c.snowIncreasing) == (1, 12)
    assert d.hailSizeIn is None and d.snowIncreasing is None and d.secondLocationCeiling == [] and d.towerSurfaceVisibility == []


def test_events_and_missing_data(said):
    a, b = said("RAB15E32B1248SNE05 TSRAB07 XXB10 FEW020 V BKN FG FEW001 VISNO RWY06 CHINO TSNO RWY06", "RAB15E32B1248 SNE05 DUST")
    assert plain(a.precipitationEvents) == [("TSRA", "BEGIN", 12, 7)]
    assert plain(a.variableSkyCondition) == [("FEW", "BKN", 2000)] and plain(a.obscurations) == [("FG", "FEW", 100)]
    assert a.missingData == ["VISNO RWY06", "CHINO", "TSNO"]
    assert plain(b.precipitationEvents) == [("RA", "BEGIN", 12, 15), ("RA", "END", 12, 32), ("RA", "BEGIN", 12, 48), ("SN", "END", 12, 5)]


def test_no_remarks_and_empty_ones(said):
    none, empty, blanks = said(None, "", "   AO1    $ ")
    assert none is None and empty is None
    assert blanks.stationType == "AO1" and blanks.isMaintenanceNeeded and blanks.lightning == [] and blanks.variableVisibility is None


def test_columns_are_the_fields_of_the_remarks(spark):
    rows = spark.createDataFrame([(1, "METAR KABC 011200Z 10SM CLR RMK AO2 PK WND 28045/15 TSB10E25 SLP012 $"), (2, "METAR KABC 011200Z 10SM CLR")], "n int, raw string")
    whole = {r["n"]: r["remarks"] for r in metar.parse(rows).collect()}
    columns = {r["n"]: r.asDict() for r in metar.parse_remarks(rows).collect()}
    assert {k: v for k, v in columns[1].items() if k != "n"} == whole[1].asDict()
    assert whole[2] is None and all(v is None for k, v in columns[2].items() if k != "n")
