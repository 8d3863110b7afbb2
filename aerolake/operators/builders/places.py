"""Airports, navaids and fixes from tables of text columns with the published column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...sources.text import code, flag, number, whole
from .. import cover

# Published codes and the names that they stand for.
FACILITIES = {"A": "AIRPORT", "H": "HELIPORT", "C": "SEAPLANE_BASE", "G": "GLIDERPORT", "U": "ULTRALIGHT", "B": "BALLOONPORT"}
OWNERS = {"PU": "PUBLIC", "PR": "PRIVATE", "MA": "PRIVATE", "MN": "PRIVATE", "MR": "PRIVATE", "CG": "PRIVATE"}
USES = {"PU": "PUBLIC", "PR": "PRIVATE"}
STATUSES = {"O": "OPEN", "CI": "CLOSED_INDEFINITELY", "CP": "CLOSED_PERMANENTLY"}
CONDITIONS = {c: c for c in ("EXCELLENT", "GOOD", "FAIR", "POOR", "FAILED")}
TREATMENTS = {"GRVD": "GROOVED", "PFC": "PFC", "GRVD-PFC": "GROOVED_PFC"}
LIGHTS = {"HIGH": "HIGH", "MED": "MEDIUM", "LOW": "LOW", "NSTD": "NONSTANDARD", "NONE": "NONE"}
SLOPE_LIGHTS = {
    "V2L": "VASI-2L", "V4L": "VASI-4L", "V2R": "VASI-2R", "V6L": "VASI-6L", "V12": "VASI-12", "V16": "VASI-16", "P2L": "PAPI-2L", "P4L": "PAPI-4L",
    "P2R": "PAPI-2R", "P4R": "PAPI-4R", "PVASI": "PVASI", "SAVASI": "SAVASI", "TRCOL": "TRICOLOR", "PANL": "PANELS",
}
MARKINGS = {m: m for m in ("PIR", "NPI", "BSC", "BUOY", "STOL", "NONE")}
MARKING_CONDITIONS = {c: c for c in ("GOOD", "FAIR", "POOR")}
LANDING_SYSTEMS = {"LS": "ILS", "LD": "ILS/DME", "LC": "LOCALIZER", "LE": "LOC/DME", "LG": "LOC/GS", "LA": "LDA", "DD": "LDA/DME", "SF": "SDF", "SD": "SDF/DME"}
LANDING_CATEGORIES = {c: c for c in ("I", "II", "III", "IIIA", "IIIB", "IIIC")}
GLIDE_SLOPES = {"GS": "GLIDE SLOPE", "GD": "GLIDE SLOPE/DME"}
NAVAIDS = {n: n.replace(" ", "_") for n in ("VOR", "VORTAC", "VOR/DME", "TACAN", "DME", "NDB", "NDB/DME", "FAN MARKER", "MARINE NDB", "VOT")}
NAVAID_STATUSES = {
    "OPERATIONAL IFR": "OPERATIONAL_IFR", "OPERATIONAL RESTRICTED": "OPERATIONAL_RESTRICTED", "OPERATIONAL VFR ONLY": "OPERATIONAL_VFR", "SHUTDOWN": "SHUTDOWN",
}
MEGAHERTZ = ["VOR", "VORTAC", "VOR/DME", "TACAN", "DME", "VOT"]
FIX_USES = {u: u for u in ("WP", "RP", "MW", "MR", "CN", "VFR", "NRS", "RADAR")}
COMPULSORY = {c: c for c in ("HIGH", "LOW", "LOW/HIGH")}

#: name in the result: (published column, how it is read)
Columns = dict[str, tuple[str, object]]
TEXT = None

RUNWAY_END: Columns = {
    "id": ("RWY_END_ID", TEXT), "trueHeadingDeg": ("TRUE_ALIGNMENT", whole), "rightTraffic": ("RIGHT_HAND_TRAFFIC_PAT_FLAG", flag), "markingType": ("RWY_MARKING_TYPE_CODE", MARKINGS),
    "markingCondition": ("RWY_MARKING_COND", MARKING_CONDITIONS), "lat": ("LAT_DECIMAL", number), "lon": ("LONG_DECIMAL", number), "elevationFt": ("RWY_END_ELEV", number),
    "thresholdCrossingHeightFt": ("THR_CROSSING_HGT", number), "glidepathAngleDeg": ("VISUAL_GLIDE_PATH_ANGLE", number), "displacedThresholdFt": ("DISPLACED_THR_LEN", whole),
    "displacedThresholdElevationFt": ("DISPLACED_THR_ELEV", number), "tdzElevationFt": ("TDZ_ELEV", number), "vgsiType": ("VGSI_CODE", SLOPE_LIGHTS),
    "hasRvr": ("RWY_VISUAL_RANGE_EQUIP_CODE", flag), "approachLights": ("APCH_LGT_SYSTEM_CODE", TEXT), "hasReil": ("RWY_END_LGTS_FLAG", flag),
    "hasCenterlineLights": ("CNTRLN_LGTS_AVBL_FLAG", flag), "hasTdzLights": ("TDZ_LGT_AVBL_FLAG", flag), "toraFt": ("TKOF_RUN_AVBL", whole), "todaFt": ("TKOF_DIST_AVBL", whole),
    "asdaFt": ("ACLT_STOP_DIST_AVBL", whole), "ldaFt": ("LNDG_DIST_AVBL", whole), "lahsoDistanceFt": ("LAHSO_ALD", whole), "lahsoEntity": ("RWY_END_INTERSECT_LAHSO", TEXT),
}
RUNWAY: Columns = {
    "id": ("RWY_ID", TEXT), "lengthFt": ("RWY_LEN", whole), "widthFt": ("RWY_WIDTH", whole), "surfaceType": ("SURFACE_TYPE_CODE", TEXT), "condition": ("COND", CONDITIONS),
    "treatment": ("TREATMENT_CODE", TREATMENTS), "pcn": ("PCN", TEXT), "lighting": ("RWY_LGT_CODE", LIGHTS), "weightLimitSingleWheelKlb": ("GROSS_WT_SW", number),
    "weightLimitDualWheelKlb": ("GROSS_WT_DW", number), "weightLimitDualTandemKlb": ("GROSS_WT_DTW", number), "weightLimitDdtKlb": ("GROSS_WT_DDTW", number),
}
AIRPORT: Columns = {
    "faaId": ("ARPT_ID", TEXT), "icao": ("ICAO_ID", TEXT), "name": ("ARPT_NAME", TEXT), "facilityType": ("SITE_TYPE_CODE", FACILITIES), "ownershipType": ("OWNERSHIP_TYPE_CODE", OWNERS),
    "useType": ("FACILITY_USE_CODE", USES), "status": ("ARPT_STATUS", STATUSES), "city": ("CITY", TEXT), "state": ("STATE_CODE", TEXT), "country": ("COUNTRY_CODE", TEXT),
    "county": ("COUNTY_NAME", TEXT), "lat": ("LAT_DECIMAL", number), "lon": ("LONG_DECIMAL", number), "elevationFt": ("ELEV", number), "magneticVariationDeg": ("MAG_VARN", number),
    "magneticVariationDirection": ("MAG_HEMIS", TEXT), "magneticVariationYear": ("MAG_VARN_YEAR", whole), "trafficPatternAltitudeFt": ("TPA", number), "sectionChart": ("CHART_NAME", TEXT),
    "artccId": ("RESP_ARTCC_ID", TEXT), "towerType": ("TWR_TYPE_CODE", TEXT), "fuelTypes": ("FUEL_TYPES", TEXT), "airframeRepair": ("AIRFRAME_REPAIR_SER_CODE", TEXT),
    "powerplantRepair": ("PWR_PLANT_REPAIR_SER", TEXT), "bottledOxygen": ("BOTTLED_OXY_TYPE", TEXT), "bulkOxygen": ("BULK_OXY_TYPE", TEXT), "lightingSchedule": ("LGT_SKED", TEXT),
    "beaconColor": ("BCN_LENS_COLOR", TEXT), "hasLandingFee": ("LNDG_FEE_FLAG", flag), "activationDate": ("ACTIVATION_DATE", TEXT), "otherServices": ("OTHER_SERVICES", TEXT),
    "notamId": ("NOTAM_ID", TEXT),
}
NAVAID: Columns = {
    "identifier": ("NAV_ID", TEXT), "name": ("NAME", TEXT), "type": ("NAV_TYPE", NAVAIDS), "status": ("NAV_STATUS", NAVAID_STATUSES), "lat": ("LAT_DECIMAL", number),
    "lon": ("LONG_DECIMAL", number), "country": ("COUNTRY_CODE", TEXT), "state": ("STATE_CODE", TEXT), "city": ("CITY", TEXT), "elevationFt": ("ELEV", number),
    "tacanChannel": ("CHAN", TEXT), "magneticVariationDeg": ("MAG_VARN", number), "magneticVariationDirection": ("MAG_VARN_HEMIS", TEXT), "magneticVariationYear": ("MAG_VARN_YEAR", whole),
    "lowArtccId": ("LOW_ALT_ARTCC_ID", TEXT), "highArtccId": ("HIGH_ALT_ARTCC_ID", TEXT), "navaidClass": ("ALT_CODE", TEXT), "dmeServiceVolume": ("DME_SSV", TEXT),
    "powerOutputWatts": ("PWR_OUTPUT", whole), "simultaneousVoice": ("SIMUL_VOICE_FLAG", flag), "ndbClass": ("NDB_CLASS_CODE", TEXT), "publicUse": ("PUBLIC_USE_FLAG", flag),
    "operatingHours": ("OPER_HOURS", TEXT), "notamId": ("NOTAM_ID", TEXT), "markerIdentifier": ("MKR_IDENT", TEXT), "markerShape": ("MKR_SHAPE", TEXT), "markerBearingDeg": ("MKR_BRG", number),
}
FIX: Columns = {
    "identifier": ("FIX_ID", TEXT), "icaoRegionCode": ("ICAO_REGION_CODE", TEXT), "state": ("STATE_CODE", TEXT), "country": ("COUNTRY_CODE", TEXT), "lat": ("LAT_DECIMAL", number),
    "lon": ("LONG_DECIMAL", number), "useCode": ("FIX_USE_CODE", FIX_USES), "highArtccId": ("ARTCC_ID_HIGH", TEXT), "lowArtccId": ("ARTCC_ID_LOW", TEXT),
    "minimumReceptionAltitudeFt": ("MIN_RECEP_ALT", whole), "compulsory": ("COMPULSORY", COMPULSORY), "previousIdentifier": ("FIX_ID_OLD", TEXT), "chartingRemark": ("CHARTING_REMARK", TEXT),
}


def _column(table: DataFrame, name: str) -> Column:
    """A text column, empty ones null; null where the table doesn't have it."""
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in table.columns else F.lit(None).cast("string")


def _read(table: DataFrame, columns: Columns) -> list[Column]:
    out = []
    for name, (source, how) in columns.items():
        text = _column(table, source)
        out.append((text if how is None else code(text, how) if isinstance(how, dict) else how(text)).alias(name))
    return out


def _needed(*names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & F.col(name).isNotNull()
    return test


def landing_systems(base: DataFrame, slopes: DataFrame, distances: DataFrame) -> DataFrame:
    """(SITE_NO, RWY_END_ID, ils): one per runway end, the last that is neither unknown nor shut down."""
    key = ["SITE_NO", "RWY_END_ID"]

    def last(table: DataFrame, *columns: Column) -> DataFrame:
        picked = table.select("ord", *[_column(table, k).alias(k) for k in key], F.struct(*columns).alias("r"))
        return picked.where(_needed(*key)).groupBy(*key).agg(F.max_by("r", "ord").alias("r"))

    slope = last(slopes, number(_column(slopes, "G_S_ANGLE")).alias("glideSlopeAngleDeg"), code(_column(slopes, "G_S_TYPE_CODE"), GLIDE_SLOPES).alias("glideSlopeType"))
    distance = last(distances, _column(distances, "CHANNEL").alias("dmeChannel"))
    system = code(_column(base, "SYSTEM_TYPE_CODE"), LANDING_SYSTEMS)
    good = base.where(system.isNotNull() & ~_column(base, "COMPONENT_STATUS").eqNullSafe("SHUTDOWN"))
    main = last(
        good, system.alias("systemType"), F.concat(F.lit("I-"), _column(good, "ILS_LOC_ID")).alias("identifier"), code(_column(good, "CATEGORY"), LANDING_CATEGORIES).alias("category"),
        number(_column(good, "LOC_FREQ")).alias("localizerFrequencyMhz"), number(_column(good, "APCH_BEAR")).alias("localizerMagneticCourseDeg"),
    )
    joined = main.select(*key, "r.*").join(slope.select(*key, "r.*"), key, "left").join(distance.select(*key, "r.*"), key, "left")
    return joined.select(*key, F.struct(*[c for c in joined.columns if c not in key]).alias("ils"))


def _list(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """The items of each key in file order."""
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", F.col(item).alias("item")))).alias("l"))
    return listed.select(*key, F.transform("l", lambda x: x["item"]).alias(item))


def runways(runway: DataFrame, ends: DataFrame, ils: DataFrame) -> DataFrame:
    """(SITE_NO, runways): every runway with its ends, each with its landing system."""
    key = ["SITE_NO", "RWY_ID"]
    end = ends.select("ord", *[_column(ends, k).alias(k) for k in key], F.struct(*_read(ends, RUNWAY_END)).alias("e")).where(_needed(*key))
    end = end.withColumn("RWY_END_ID", F.col("e.id")).join(ils, ["SITE_NO", "RWY_END_ID"], "left")
    end = end.withColumn("ends", F.struct("e.*", "ils"))
    named = runway.select("ord", *[_column(runway, k).alias(k) for k in key], F.struct(*_read(runway, RUNWAY)).alias("r")).where(_needed(*key))
    both = named.join(_list(end, key, "ends"), key, "left")
    empty = F.col("ends").isNull()
    both = both.withColumn("runways", F.struct("r.*", F.when(empty, F.slice("ends", 1, 0)).otherwise(F.col("ends")).alias("ends")))
    return _list(both, ["SITE_NO"], "runways")


def frequencies(table: DataFrame) -> DataFrame:
    """(facility, frequencies) of the rows with a frequency and a use."""
    item = F.struct(number(_column(table, "FREQ")).alias("frequencyMhz"), _column(table, "FREQ_USE").alias("use"), _column(table, "SECTORIZATION").alias("sectorization"))
    rows = table.select("ord", F.coalesce(_column(table, "SERVICED_FACILITY"), _column(table, "FACILITY")).alias("facility"), item.alias("frequencies"))
    return _list(rows.where("facility is not null and frequencies.frequencyMhz is not null and frequencies.use is not null"), ["facility"], "frequencies")


def airports(base: DataFrame, runway: DataFrame, ends: DataFrame, radio: DataFrame, ils: DataFrame, slopes: DataFrame, distances: DataFrame) -> DataFrame:
    """Airports of the seven published tables, each with an `ord`: runways, ends, landing systems and frequencies nested.

    An airport without a name, place, position or a known type, owner, use and status is left out.
    Joins are by site number, runway and runway end; lists are as long as one airport's. Time zones
    need a table of zones: see `with_time_zones`.
    """
    read = base.select("ord", _column(base, "SITE_NO").alias("SITE_NO"), *_read(base, AIRPORT))
    read = read.where(_needed("faaId", "name", "city", "country", "SITE_NO", "lat", "lon", "facilityType", "ownershipType", "useType", "status"))
    nested = read.join(runways(runway, ends, landing_systems(ils, slopes, distances)), "SITE_NO", "left")
    return nested.join(frequencies(radio).withColumnRenamed("facility", "faaId"), "faaId", "left").drop("SITE_NO")


def with_time_zones(built: DataFrame, zones: DataFrame) -> DataFrame:
    """Airports (faaId, lat, lon) with timezone: the name of the first zone (tzid, boundary) by name that holds them, null where none does."""
    covered = cover.cover(zones.select(F.col("tzid").alias("timezone"), "boundary"))
    return cover.first_holding(covered, built, ["faaId"], ["timezone"], ["timezone"])


def navaids(table: DataFrame) -> DataFrame:
    """Navaids that are not shut down and have a name, place, position and a known type and status."""
    read = table.select("ord", *_read(table, NAVAID), number(_column(table, "FREQ")).alias("f"), *[number(_column(table, f"TACAN_DME_{c}_DECIMAL")).alias(n) for n, c in (("dLat", "LAT"), ("dLon", "LONG"))])
    read = read.where(_needed("identifier", "name", "country", "lat", "lon", "type", "status") & (F.col("status") != "SHUTDOWN"))
    tuned = F.col("type").isin(MEGAHERTZ)
    apart = F.col("dLat").isNotNull() & F.col("dLon").isNotNull() & ((F.col("dLat") != F.col("lat")) | (F.col("dLon") != F.col("lon")))
    return read.withColumns({
        "frequencyMhz": F.when(tuned, F.col("f")), "frequencyKhz": F.when(~tuned, F.col("f")), "dmeLat": F.when(apart, F.col("dLat")), "dmeLon": F.when(apart, F.col("dLon")),
    }).drop("f", "dLat", "dLon")


def fixes(base: DataFrame, charts: DataFrame, stations: DataFrame) -> DataFrame:
    """Fixes but for those of navigation computers, the last of an identifier and region, with charts and navaids.

    chartTypes are those listed with the fix, then those of the chart table, each once, in order of
    first mention; navaidAssociations are the station rows with all four fields.
    """
    key = ["identifier", "icaoRegionCode"]
    flags = [F.coalesce(flag(_column(base, c)), F.lit(False)).alias(n) for n, c in (("pitch", "PITCH_FLAG"), ("catch", "CATCH_FLAG"), ("suaAtcaa", "SUA_ATCAA_FLAG"))]
    listed = F.filter(F.transform(F.split(F.coalesce(_column(base, "CHARTS"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    read = base.select("ord", *_read(base, FIX), *flags, listed.alias("listed")).where(_needed(*key, "country", "lat", "lon", "useCode") & (F.col("useCode") != "CN"))
    last = read.groupBy(*key).agg(F.max_by(F.struct(*[c for c in read.columns if c not in key]), "ord").alias("r")).select(*key, "r.*")

    def of(table: DataFrame, item: Column, name: str) -> DataFrame:
        rows = table.select("ord", _column(table, "FIX_ID").alias(key[0]), _column(table, "ICAO_REGION_CODE").alias(key[1]), item.alias(name))
        return _list(rows.where(_needed(*key, name)), key, name)

    parts = {"navaidId": _column(stations, "NAV_ID"), "navaidType": _column(stations, "NAV_TYPE"), "bearingDeg": number(_column(stations, "BEARING")), "distanceNm": number(_column(stations, "DISTANCE"))}
    complete = F.lit(True)
    for part in parts.values():
        complete = complete & part.isNotNull()
    station = F.when(complete, F.struct(*[v.alias(n) for n, v in parts.items()]))
    joined = last.join(of(charts, _column(charts, "CHARTING_TYPE_DESC"), "charted"), key, "left").join(of(stations, station, "navaidAssociations"), key, "left")
    every = F.array_distinct(F.concat("listed", F.coalesce("charted", F.array().cast("array<string>"))))
    return joined.withColumn("chartTypes", every).drop("listed", "charted")
