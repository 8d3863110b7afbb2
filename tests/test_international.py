"""International advisories in all their formats."""

import pytest

from aerolake.operators.reports import advisories, international

SAID = {
    "turbulence": "WSAK05 PAWU 121014\nSIGAK5\nANCM WS 121015\nPAZA SIGMET KILO 2 VALID 121015/121415 PANC-\nPAZA ANCHORAGE FIR SEV TURB OBS AT 1009Z AREA WI 30 NM E ABC - 20 NM W\nDEF - 30 NM E ABC SFC/FL120 STNR NC=\n\nINCLUDES +/- 30KTS LLWS.",
    "cancelled": "PAZA SIGMET KILO 3 VALID 121200/121230 PANC-\nPAZA ANCHORAGE FIR CNL SIGMET KILO 2 121015/121415=",
    "cancelled fused": "SCCZ SIGMET B8 VALID 121200/121230 SCCI-\nSCCZ PUNTA ARENAS FIR CNL SIGMET B7 120915/121415=",
    "cancelled number": "SCCZ SIGMET 8 VALID 121200/121230 SCCI-\nSCCZ PUNTA ARENAS FIR CNL SIGMET 7 120915/121415=",
    "cyclone": "WSNT02 KNHC 121500\nSIGMET LIMA 4 VALID 121500/122100 KNHC-\nKZMA MIAMI OCEANIC FIR TC GRETA OBS AT 1500Z N2415 W08245\nCB TOP FL520 WI 150NM OF CENTER MOV NNW 14KT INTSF\nFCST AT 2100Z TC CENTER N2530 W08345",
    "cyclone behind": "KZMA SIGMET LIMA 4 VALID 121500/122100 KNHC-\nKZMA MIAMI OCEANIC FIR OBS AT 1500Z TC GRETA N2415 W08245 MOV W 5KT",
    "ash": "PAZA SIGMET JULIETT 1 VALID 120702/121302 PANC-\nANCHORAGE FIR VA ERUPTION MT HOLLOW PSN N5530 W16115\nVA CLD OBS AT 0702Z WI N5600 W16100 - N5500 W16000 -\nN5500 W16200 - N5600 W16100 SFC/FL080 MOV STNR WKN\nFCST 1302Z VA CLD WI N5700 W16100 - N5500 W15900 - N5700 W16100 FL100/FL120",
    "whole": "UTAT SIGMET N 5 VALID 051525/051925 UTAT-\nDASHOGUZ FIR OBSC TS FCST ENTIRE FIR TOP FL370 MOV NE 20KMH NC=",
    "line": "SCCZ SIGMET AB12 VALID 162347/170347 SCCI -\nSCCZ PUNTA ARENAS FIR SEV ICE (FZRA) FCST E OF LINE S4700 W07800 - S6000 W07600 FL160/360 STNR NC=",
    "two": "KZMA TJZS SIGMET GOLF 3 VALID 170145/170545 KKCI-\nKZMA MIAMI OCEANIC FIR TJZS SAN JUAN FIR EMBD TS OBS AND FCST WI\nN2500 W07500 - S0000 E17959. TOP ABV FL450. MOV NW 10KT.\nINTSF.",
    "expected": "YBBB SIGMET 140 VALID 170145/170545 YBBB-\nYBBB BRISBANE FIR SEV TURB FCST AT 0300Z WI N2500 E15000 - N2500 E16000 BTN FL200 AND FL300",
    "bare": "YBBB SIGMET 140 VALID 170145/170545 YBBB-\nYBBB BRISBANE FIR=",
    "nothing behind": "YBBB SIGMET 140 VALID 170145/170545 YBBB-",
    "domestic ash": "SIGMET PAPA 1 VALID UNTIL 120135\nAK\nVOLCANIC ASH FROM ERUPTION OF MT HOLLOW 5530N16115W. FROM ABC TO DEF TO GHI. VA CLD OBS AT 1930Z FL250/FL350. FCST AT 0130Z SFC/FL300.",
    "unknown": "nothing of the sort",
    "empty": "",
    "null": None,
}


@pytest.fixture(scope="module")
def read(spark):
    rows = spark.createDataFrame(list(SAID.items()), "name string, raw string")
    return {r["name"]: r.asDict(recursive=True) for r in advisories.parse_sigmet(rows).collect()}


def _is(row, **values):
    assert {k: row[k] for k in values} == values


def _at(day, hour, minute):
    return {"day": day, "hour": hour, "minute": minute}


def test_turbulence(read):
    row = read["turbulence"]
    _is(row, format="INTERNATIONAL", firCode="PAZA", firName="ANCHORAGE FIR", seriesName="KILO", number=2, issuingStation="PANC", isCancellation=False, phenomena="SEV TURB", observationStatus="OBSERVED")
    _is(row, validFrom=_at(12, 10, 15), validTo=_at(12, 14, 15), observedAt=_at(None, 10, 9), areaDescription="30 NM E ABC - 20 NM W DEF - 30 NM E ABC", isStationary=True, intensityChange="NO_CHANGE", cancelled=None, error=None)
    _is(row, altitudes={"base": "SFC", "baseFt": None, "top": "FL120", "topFt": 12000}, additionalInfo="INCLUDES +/- 30KTS LLWS.", cycloneName=None, topsFt=None, areaPoints=[])


def test_cancellations(read):
    for name, series, number, start in (("cancelled", "KILO", 2, _at(12, 10, 15)), ("cancelled fused", "B", 7, _at(12, 9, 15)), ("cancelled number", "7", 7, _at(12, 9, 15))):
        _is(read[name], isCancellation=True, cancelled={"seriesName": series, "number": number, "validFrom": start, "validTo": _at(12, 14, 15)}, phenomena=None)
    _is(read["cancelled fused"], seriesName="B", number=8, firName="PUNTA ARENAS FIR")
    _is(read["cancelled number"], seriesName="8", number=8)


def test_cyclones(read):
    row = read["cyclone"]
    _is(row, firCode="KZMA", firName="MIAMI OCEANIC FIR", phenomena="TC GRETA", cycloneName="GRETA", cyclonePosition={"lat": 24.25, "lon": -82.75}, cbTopFl=520, withinNm=150, areaDescription="150NM OF CENTER")
    _is(row, forecastTime=_at(None, 21, 0), forecastPosition={"lat": 25.5, "lon": -83.75}, topsFt=52000, topsAbove=False, intensityChange="INTENSIFYING", observationStatus="OBSERVED")
    assert (row["movement"]["directionCompass"], row["movement"]["speedKt"]) == ("NNW", 14)
    _is(read["cyclone behind"], phenomena="TC GRETA", cyclonePosition={"lat": 24.25, "lon": -82.75}, cbTopFl=None, withinNm=None, forecastPosition=None, observedAt=_at(None, 15, 0))


def test_ash(read):
    row = read["ash"]
    _is(row, firCode="PAZA", firName="ANCHORAGE FIR", phenomena="VA ERUPTION", volcanoName="MT HOLLOW", volcanoPosition={"lat": 55.5, "lon": -161.25}, isStationary=True, intensityChange="WEAKENING")
    _is(row, areaDescription="N5600 W16100 - N5500 W16000 - N5500 W16200 - N5600 W16100", forecastArea="N5700 W16100 - N5500 W15900 - N5700 W16100", forecastTime=_at(None, 13, 2))
    assert [x["lat"] for x in row["areaRing"]] == [56, 55, 55, 56]
    assert (row["altitudes"]["topFt"], row["forecastAltitudes"]["baseFt"], row["forecastAltitudes"]["topFt"]) == (8000, 10000, 12000)
    row = read["domestic ash"]
    _is(row, format="NON_CONVECTIVE", volcanoName="MT HOLLOW", areaPoints=["ABC", "DEF", "GHI"], forecastTime=_at(None, 1, 30), hazards=["VOLCANIC_ASH"])
    assert row["volcanoPosition"] == {"lat": 55.5, "lon": -161.25}
    assert (row["ashCloudAltitudes"]["baseFt"], row["ashCloudAltitudes"]["topFt"], row["forecastAltitudes"]["topFt"]) == (25000, 35000, 30000)


def test_areas_and_status(read):
    row = read["whole"]
    _is(row, seriesName="N", number=5, firCode="UTAT", phenomena="OBSC TS", observationStatus="FORECAST", isEntireRegion=True, areaDescription=None, topsFt=37000)
    assert (row["movement"]["speedKmPerHr"], row["movement"]["speedKt"]) == (20, None)
    row = read["line"]
    _is(row, seriesName="AB", number=12, issuingStation="SCCI", phenomena="SEV ICE (FZRA)", areaDescription="S4700 W07800 - S6000 W07600", areaRing=[{"lat": -47, "lon": -78}, {"lat": -60, "lon": -76}])
    assert (row["altitudes"]["baseFt"], row["altitudes"]["topFt"]) == (16000, 36000)
    row = read["two"]
    _is(row, firCode="TJZS", firName="MIAMI OCEANIC FIR TJZS SAN JUAN FIR", phenomena="EMBD TS", observationStatus="FORECAST", topsFt=45000, topsAbove=True)
    assert row["areaRing"][1] == {"lat": 0, "lon": 179 + 59 / 60}
    _is(read["expected"], seriesName="140", number=140, observationStatus=None, areaDescription="N2500 E15000 - N2500 E16000", forecastTime=_at(None, 3, 0))
    assert read["expected"]["altitudes"]["baseFt"] == 20000
    _is(read["bare"], firCode="YBBB", firName="BRISBANE FIR", phenomena=None, observationStatus=None, error=None)


def test_no_advisory(read):
    _is(read["unknown"], format=None, error="no SIGMET", phenomena=None)
    _is(read["empty"], format=None, error="no SIGMET", areaPoints=[])
    _is(read["null"], format=None, error="no SIGMET")
    _is(read["nothing behind"], phenomena=None)


def test_clauses_are_rows(spark):
    rows = spark.createDataFrame([(k, v) for k, v in SAID.items() if k in ("ash", "unknown")], "name string, raw string")
    found = [(r.position, r.owner, r.kind) for r in international.clauses(rows).orderBy("position").collect()]
    kinds = "VA PSN VA OBS AREA LEVELS MOV STNR CHANGE FCST VA AREA LEVELS".split()
    assert found == [(n, "PRESENT" if n < 9 else "FORECAST", k) for n, k in enumerate(kinds)]
