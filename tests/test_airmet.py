"""AIRMETs with all kinds of sections."""

import pytest

from aerolake.operators.reports import advisories, airmet

SAID = {
    "wind": "WAUS43 KKCI 271445\nWA3T\nCHIT WA 271445\nAIRMET TANGO UPDT 2 FOR TURB STG WNDS AND LLWS VALID UNTIL 272100\n.\nAIRMET TURB...NE KS AND CSTL WTRS\nFROM 20SE AAA TO 50E BBB TO\nCCC TO 20SE AAA\nMOD TURB BLW 120. CONDS CONTG BYD 21Z THRU 03Z.\n.\n"
    "LLWS POTENTIAL...MN IA LM\nBOUNDED BY 70WNW DDD-20SSE EEE-40ENE FFF-\n30ENE GGG-70WNW DDD\nLLWS EXP. CONDS ENDG 18-21Z.\n.\nAIRMET STG SFC WNDS...ND\nFROM AAA-BBB-AAA\nSUSTAINED SURFACE WINDS GTR THAN 30KT EXP DUE TO STG PRES GRAD. CONDS CONTG BYD 21Z ENDG BY 02Z.",
    "ice": "BOSZ WA 271445\nAIRMET ZULU UPDT 2 FOR ICE AND FRZLVL VALID UNTIL 272100\n.\nAIRMET ICE...ME NH\nFROM 70NW AAA TO BBB TO 70NW AAA\nMOD ICE BTN FRZLVL AND FL190. FRZLVL 020-060. CONDS ENDG 18-21Z.\n.\nOTLK VALID 2100-0300Z\nAREA 1...ICE OH LE\nBOUNDED BY 40S AAA-40W BBB-40S AAA\nMOD ICE BTN 040 AND 170. CONDS DVLPG AFT 00Z. CONDS CONTG THRU\n03Z.\n.\n"
    "AREA 2...TURB VT NY\nBOUNDED BY 20N CCC-DDD-20N CCC\nSEV TURB BTN FL300 AND FL400. CONDS DVLPG 00-02Z.\n.\nFRZLVL...RANGING FROM SFC-110 ACRS AREA\n   MULT FRZLVL BLW 090 BOUNDED BY 60W AAA-50N BBB-\n      20E CCC-60W AAA\n   MULT FRZLVL BLW 110 BOUNDED BY DDD-EEE-DDD\n   040 ALG 20S FFF-80E GGG\n   SFC ALG 40W HHH-20S III\n   080 ALG JJJ",
    "parallels": "AIRMET ZULU FOR ICE AND FRZLVL\nVALID UNTIL 050400Z\nNO SIGNIFICANT ICE EXPECTED.\nFRZLVL...SFC-020 N OF 40N LINE. 040-080 S OF 40N LINE.\nMULT FRZLVL BLW 080 BOUNDED BY 30W AAA-30N BBB-30W AAA.",
    "inline": "AIRMET ZULU FOR ICE AND FRZLVL\nVALID UNTIL 050400Z\nAIRMET ICE...NH VT\nFROM 30N AAA-40E BBB-30N AAA\nMOD ICE BTN 040 AND FL220. CONDS CONTG BYD 0400Z.\nFRZLVL...040-060 ACRS AREA.",
    "none": "AIRMET TANGO FOR TURB VALID UNTIL 272100\n.\nNO SIGNIFICANT TURB EXP. NO SIGNIFICANT STG SFC WNDS EXP.\n.\nAREA 1...TURB OH BOUNDED BY A-B-A MOD TURB BLW 100.",
    "unknown": "nothing of the sort", "empty": "", "null": None,
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame(list(SAID.items()), "name string, raw string")
    return {r["name"]: r.asDict(recursive=True) for r in advisories.parse_airmet(rows).collect()}


def _is(row, **values):
    assert {k: row[k] for k in values} == values


def _at(hour, minute=0, day=None):
    return {"day": day, "hour": hour, "minute": minute}


def test_heads(read):
    _is(read["wind"], series="TANGO", updateNumber=2, purposes="TURB STG WNDS AND LLWS", products=["TURB STG WNDS", "LLWS"], validUntil=_at(21, 0, 27), issuingOffice="CHIT", issuedAt=_at(14, 45, 27), freezingLevel=None, outlooks=[], error=None)


def test_hazards(read):
    turbulence, shear, wind = read["wind"]["hazards"]
    _is(turbulence, hazardType="TURBULENCE", states=["NE", "KS"], coastalWaters=True, areaPoints=["20SE AAA", "50E BBB", "CCC", "20SE AAA"], boundedBy=[], condition="MOD TURB", description="MOD TURB BLW 120")
    _is(turbulence["altitudes"], base=None, baseFt=None, topFt=12000)
    _is(turbulence["conditions"], status="CONTINUING", startTime=_at(21), endTime=_at(3), isAfter=False)
    _is(shear, hazardType="LOW_LEVEL_WIND_SHEAR", states=["MN", "IA", "LM"], areaPoints=[], boundedBy=["70WNW DDD", "20SSE EEE", "40ENE FFF", "30ENE GGG", "70WNW DDD"], description="LLWS EXP", altitudes=None)
    _is(shear["conditions"], status="ENDING", startTime=_at(18), endTime=_at(21))
    _is(wind, hazardType="STRONG_SURFACE_WIND", cause="STG PRES GRAD", condition="SUSTAINED SURFACE WINDS GTR THAN 30KT")
    _is(wind["conditions"], status="CONTINUING", startTime=_at(21), endTime=_at(2))


def test_ice_keeps_its_freezing_levels(read):
    (ice,) = read["ice"]["hazards"]
    _is(ice, hazardType="ICING", description="MOD ICE BTN FRZLVL AND FL190. FRZLVL 020-060", altitudes={"base": "FRZLVL", "baseFt": None, "top": "FL190", "topFt": 19000})
    _is(ice["conditions"], status="ENDING", startTime=_at(18), endTime=_at(21))


def test_outlook_areas_behind_stops(read):
    one, two = read["ice"]["outlooks"]
    _is(one, areaNumber=1, validFrom=_at(21), validTo=_at(3), hazardType="ICING", states=["OH", "LE"], boundedBy=["40S AAA", "40W BBB", "40S AAA"], description="MOD ICE BTN 040 AND 170")
    _is(one["conditions"], status="DEVELOPING", startTime=_at(0), endTime=_at(3), isAfter=True)
    _is(two, areaNumber=2, validFrom=_at(21), hazardType="TURBULENCE", states=["VT", "NY"], description="SEV TURB BTN FL300 AND FL400")
    _is(two["conditions"], status="DEVELOPING", startTime=_at(0), endTime=_at(2), isAfter=False)
    assert read["none"]["outlooks"] == []


def test_freezing_levels(read):
    level = read["ice"]["freezingLevel"]
    _is(level, range="SFC-110 ACRS AREA", rangeLowFt=None, rangeHighFt=11000)
    assert level["contours"] == [{"altitudeFt": None, "location": "ALG 40W HHH-20S III"}, {"altitudeFt": 4000, "location": "ALG 20S FFF-80E GGG"}, {"altitudeFt": 8000, "location": "ALG JJJ"}]
    assert level["multiple"] == [{"belowFt": 9000, "boundedBy": ["60W AAA", "50N BBB", "20E CCC", "60W AAA"]}, {"belowFt": 11000, "boundedBy": ["DDD", "EEE", "DDD"]}]
    level = read["parallels"]["freezingLevel"]
    _is(level, range=None, rangeLowFt=None, rangeHighFt=8000, multiple=[{"belowFt": 8000, "boundedBy": ["30W AAA", "30N BBB", "30W AAA"]}])
    assert level["contours"] == [{"altitudeFt": None, "location": "SFC-020 N OF 40N LINE"}, {"altitudeFt": 4000, "location": "040-080 S OF 40N LINE"}]
    _is(read["inline"]["freezingLevel"], range="040-060 ACRS AREA", rangeLowFt=4000, rangeHighFt=6000, contours=[], multiple=[])
    assert [h["description"] for h in read["inline"]["hazards"]] == ["MOD ICE BTN 040 AND FL220"]


def test_nothing(read):
    assert read["none"]["nilStatements"] == ["NO SIGNIFICANT TURB EXP", "NO SIGNIFICANT STG SFC WNDS EXP"]
    assert read["parallels"]["nilStatements"] == ["NO SIGNIFICANT ICE EXPECTED"]
    for name in ("unknown", "empty", "null"):
        _is(read[name], series=None, hazards=[], outlooks=[], nilStatements=[], freezingLevel=None, error="no AIRMET series")


def test_sections_as_rows(spark):
    rows = airmet.sections(spark.createDataFrame([("a", SAID["ice"])], "kind_of string, raw string")).orderBy("place").collect()
    assert [r["kind"] for r in rows] == ["HEAD", "HAZARD", "OUTLOOK", "AREA", "AREA", "FREEZING"]
    assert [r["valid"] for r in rows] == [None, None] + ["2100-0300Z"] * 4


def test_rows_are_what_the_bulletins_list(spark):
    rows = spark.createDataFrame(list(SAID.items()), "name string, raw string")
    listed = {r["name"]: r.asDict(recursive=True) for r in advisories.parse_airmet(rows).collect()}
    for made, column in ((airmet.hazards(rows), "hazards"), (airmet.outlooks(rows), "outlooks")):
        found = {}
        for r in made.orderBy("name", "pos").collect():
            r = r.asDict(recursive=True)
            found.setdefault(r["name"], []).append({k: r[k] for k in listed[r["name"]][column][0]})
        assert found == {name: r[column] for name, r in listed.items() if r[column]} and found
