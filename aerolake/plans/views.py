"""Aviation tables projected from the driver's tables by integer arithmetic that both engines share.

Each view is one text for Spark and DuckDB; `{array}` is the engine's array constructor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import flight, geo, units
from ..functions.sqlfn import register

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Vertices of an octagon in thousandths of its radius, the first again at the end.
_OCTAGON = ((1000, 0), (700, 700), (0, 1000), (-700, 700), (-1000, 0), (-700, -700), (0, -1000), (700, -700), (1000, 0))


def _ring() -> str:
    points = ", ".join(f"{{array}}(lon + radius * {x}e0 / 1e3, lat + radius * {y}e0 / 1e3)" for x, y in _OCTAGON)
    return f"{{array}}({points})"


#: Corners of an uneven ring; every fourth part of them lies on one side of a square.
CORNERS = 64


def _uneven_ring() -> str:
    """The ring of the area of `zone` around lon and lat: corners on a square, drawn in by up to a third, the first again at the end."""

    def corner(i: int) -> str:
        side, t = i * 4 // CORNERS, i * 8000 // CORNERS % 2000 - 1000
        u, v = ((t, -1000), (1000, t), (-t, 1000), (-1000, -t))[side]
        drawn = f"(100 - (zone * {i * 7 + 3} + {i * 13}) % 34)"
        return f"{{array}}(lon + radius * {u} * {drawn} / 1e5, lat + radius * {v} * {drawn} / 1e5)"

    return f"{{array}}({', '.join(corner(i % CORNERS) for i in range(CORNERS + 1))})"


VIEWS = {
    "airports": """select c_custkey as ord, concat('K', lpad(cast(c_custkey as string), 5, '0')) as icao, concat('F', cast(c_custkey as string)) as faaId,
        c_name as name, c_mktsegment as type, 24e0 + (c_custkey * 7919 % 25000) / 1e3 as lat, -125e0 + (c_custkey * 104729 % 58000) / 1e3 as lon,
        floor(abs(c_acctbal)) as elevationFt, c_custkey % 13 * 1000 + 500 as longestRunwayFt, c_custkey * 37 % 20000 * 1e0 as altitudeFt from customer""",
    "navaids": """select s_suppkey as ord, concat('N', lpad(cast(s_suppkey % 70 as string), 3, '0')) as identifier, s_name as name,
        case when s_suppkey % 4 = 0 then 'NDB' when s_suppkey % 4 = 1 then 'VORTAC' else 'VOR' end as type,
        24e0 + (s_suppkey * 6131 % 25000) / 1e3 as lat, -125e0 + (s_suppkey * 92821 % 58000) / 1e3 as lon,
        case when s_suppkey % 4 <> 0 then 108e0 + (s_suppkey % 20) / 2e1 end as frequencyMhz, case when s_suppkey % 4 = 0 then 200e0 + s_suppkey % 20 end as frequencyKhz from supplier""",
    "fixes": """select p_partkey as ord, concat('FX', lpad(cast(p_partkey as string), 6, '0')) as identifier, p_brand as useCode,
        24e0 + (p_partkey * 7213 % 25000) / 1e3 as lat, -125e0 + (p_partkey * 81799 % 58000) / 1e3 as lon from part""",
    "airspace": f"""select ord, identifier, name, type, artccStratum, floorFt, floorReference, ceilingFt, {_ring()} as ring from (
        select n_nationkey * 3 + k as ord, concat('A', cast(n_nationkey as string)) as identifier, n_name as name,
            case when n_nationkey % 4 = 0 then 'ARTCC' when n_nationkey % 4 = 1 then 'CLASS_B' else 'CLASS_C' end as type,
            case when n_nationkey % 4 = 0 then case when k = 0 then 'LOW' else 'HIGH' end end as artccStratum,
            (n_nationkey + k) % 4 * 1500 as floorFt, case when n_regionkey = 0 then 'SFC' when n_regionkey = 1 then 'AGL' else 'MSL' end as floorReference, 8000 + (n_nationkey + k) % 7 * 2500 as ceilingFt,
            26e0 + ((n_nationkey * 3 + k) * 6131 % 21000) / 1e3 as lat, -123e0 + ((n_nationkey * 3 + k) * 92821 % 55000) / 1e3 as lon, 0.5e0 + k * 0.9e0 as radius
        from nation cross join (select 0 as k union all select 1 union all select 2) r) a""",
    "zones": f"""select zone, timezone, {_uneven_ring()} as ring from (select n_nationkey as zone, concat('America/', n_name) as timezone, 3e0 + n_nationkey % 5 as radius,
        26e0 + (n_nationkey * 6131 % 21000) / 1e3 as lat, -123e0 + (n_nationkey * 92821 % 55000) / 1e3 as lon from nation) z""",
    "flights": """select l_orderkey as route_id, l_linenumber as leg, 24e0 + (l_partkey * 7919 % 25000) / 1e3 as lat1, -125e0 + (l_partkey * 104729 % 58000) / 1e3 as lon1,
        24e0 + (l_suppkey * 6131 % 25000) / 1e3 as lat2, -125e0 + (l_suppkey * 92821 % 58000) / 1e3 as lon2, 120e0 + l_partkey * 37 % 380 as tas, (l_orderkey * 53 % 3600) / 1e1 as course,
        (l_suppkey * 71 % 3600) / 1e1 as windDeg, (l_partkey % 70) * 1e0 as windKt, (l_partkey * 131 % 34000) * 1e0 as altitude, 30e0 - (l_suppkey * 17 % 900) / 1e1 as oat,
        28e0 + (l_partkey % 300) / 1e2 as qnh, 2e0 + l_linenumber / 1e1 as angle, l_quantity * 1e0 as fuel, 5e0 + l_linenumber as burn, 10e0 + l_partkey % 900 as nm,
        l_linenumber % 2 = 0 as rightTurns, 5e0 + l_suppkey % 50 as bank from lineitem""",
    "waypoints": """select l_orderkey as ord, concat('V', cast(l_orderkey % 500 as string)) as designation, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as seq,
        concat('FX', lpad(cast(l_partkey as string), 6, '0')) as identifier, 24e0 + (l_partkey * 7213 % 25000) / 1e3 as lat, -125e0 + (l_partkey * 81799 % 58000) / 1e3 as lon from lineitem""",
    "metars": """select event_id, concat('METAR K', lpad(cast(user_id % 1000 as string), 3, '0'), ' ', lpad(cast(1 + event_id % 28 as string), 2, '0'), lpad(cast(event_id % 24 as string), 2, '0'), lpad(cast(event_id % 60 as string), 2, '0'), 'Z ',
        case when event_id % 5 = 0 then 'AUTO ' else '' end, case when event_id % 11 = 0 then '00000KT' when event_id % 7 = 0 then concat('VRB0', cast(1 + event_id % 8 as string), 'KT')
            else concat(lpad(cast(event_id % 36 * 10 as string), 3, '0'), lpad(cast(1 + event_id % 40 as string), 2, '0'), case when event_id % 3 = 0 then concat('G', cast(45 + event_id % 30 as string)) else '' end, 'KT') end, ' ',
        case when event_id % 4 = 0 then 'P6SM' when event_id % 4 = 1 then concat(cast(1 + event_id % 9 as string), 'SM') when event_id % 4 = 2 then '1 1/2SM' else 'M1/4SM' end, ' ',
        case when event_id % 6 = 0 then '-RA BR ' when event_id % 6 = 1 then '+TSRA ' else '' end,
        case when event_id % 9 = 0 then 'CLR' else concat(case when event_id % 2 = 0 then 'BKN' else 'SCT' end, lpad(cast(1 + event_id % 60 as string), 3, '0'), ' OVC', lpad(cast(62 + event_id % 100 as string), 3, '0')) end, ' ',
        case when event_id % 10 < 3 then concat('M', lpad(cast(event_id % 20 as string), 2, '0')) else lpad(cast(event_id % 35 as string), 2, '0') end, '/M05 A', cast(2800 + event_id % 300 as string), ' RMK AO2 SLP', lpad(cast(event_id % 1000 as string), 3, '0')) as raw from events""",
    "tafs": """select event_id, concat('TAF ', case when event_id % 9 = 0 then 'AMD ' else '' end, 'K', lpad(cast(user_id % 1000 as string), 3, '0'), ' 011130Z 0112/0218 ', lpad(cast(event_id % 36 * 10 as string), 3, '0'), lpad(cast(1 + event_id % 40 as string), 2, '0'), 'KT P6SM SKC',
        case when event_id % 2 = 0 then concat(' FM01', lpad(cast(12 + event_id % 10 as string), 2, '0'), '00 18012G25KT 3SM BR OVC0', cast(10 + event_id % 80 as string)) else '' end,
        case when event_id % 3 = 0 then ' PROB30 TEMPO 0200/0204 1SM TSRA BKN005CB' else '' end) as raw from events""",
    "pireps": """select event_id, concat('K', lpad(cast(user_id % 1000 as string), 3, '0'), case when event_id % 8 = 0 then ' UUA' else ' UA' end, ' /OV ABC', lpad(cast(event_id % 360 as string), 3, '0'), lpad(cast(event_id % 90 as string), 3, '0'), '/TM ', lpad(cast(event_id % 24 as string), 2, '0'), lpad(cast(event_id % 60 as string), 2, '0'),
        '/FL', lpad(cast(10 + event_id % 400 as string), 3, '0'), '/TP B738/TA ', case when event_id % 2 = 0 then 'M' else '' end, lpad(cast(event_id % 50 as string), 2, '0'), '/TB ', case when event_id % 3 = 0 then 'MOD' else 'LGT' end, '/IC NEG') as raw from events""",
    "notams": """select event_id, concat('A', lpad(cast(event_id % 10000 as string), 4, '0'), '/24 NOTAMN Q) KZNY/Q', case when event_id % 2 = 0 then 'MRLC' else 'NVAS' end, '/IV/NBO/A/000/', lpad(cast(event_id % 900 as string), 3, '0'), '/40', lpad(cast(event_id % 60 as string), 2, '0'), 'N0735', cast(event_id % 10 as string), 'W005',
        ' A) KJFK B) 24', lpad(cast(1 + event_id % 12 as string), 2, '0'), '011200 C) ', case when event_id % 3 = 0 then 'PERM' when event_id % 3 = 1 then '2412312359EST' else '2412312359' end, ' E) RWY ', cast(event_id % 36 as string), ' CLSD') as raw from events""",
    "aloft": """select event_id, lpad(cast(case when event_id % 9 = 0 then 99 when event_id % 2 = 0 then 51 + event_id % 36 else 1 + event_id % 36 end as string), 2, '0') as d,
        lpad(cast(case when event_id % 9 = 0 then 0 else event_id % 100 end as string), 2, '0') as s, lpad(cast(event_id % 60 as string), 2, '0') as t, case when event_id % 4 = 0 then 30000 else 12000 end as altitudeFt from events""",
    "registry": """select p_partkey as ord, lpad(lower(p_brand), 8, '0') as maker, p_type as model, p_partkey * 16 as icaoHex, p_size as seats from part""",
}


def oracle(name: str, sql: str, *views: str) -> str:
    """SQL for DuckDB: the views it needs, then the query."""
    texts = [f"{v} as ({VIEWS[v].replace('{array}', 'list_value')})" for v in views]
    return f"with {', '.join(texts)} {sql}" if texts else sql


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Functions of the session and its views of the tables at sf_dir."""
    for functions, mark in ((units.FUNCTIONS, "units"), (geo.FUNCTIONS, "geo"), (flight.FUNCTIONS, "flight")):
        register(spark, functions, mark)
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def view(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].replace("{array}", "array"))


def areas(spark: SparkSession) -> DataFrame:
    """Airspace rows as the spatial operators take them."""
    from ..operators.spatial import with_box

    rows = view(spark, "airspace").selectExpr(
        "ord", "identifier", "name", "type", "artccStratum", "array(ring) as boundary",
        "named_struct('valueFt', cast(floorFt as int), 'reference', floorReference) as floor", "named_struct('valueFt', cast(ceilingFt as int), 'reference', 'MSL') as ceiling",
    )
    return with_box(rows)


def airways(spark: SparkSession) -> DataFrame:
    """Airways with their ordered waypoints, those of the view `waypoints`.

    Only the numbers that a waypoint is made of are grouped, by the airway's own number, so that a
    join by this number needs no further shuffle.
    """
    from pyspark.sql import functions as F

    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items")
    listed = spark.table("lineitem").select(F.col("l_orderkey").alias("ord"), "l_linenumber", "l_partkey").groupBy("ord").agg(items)
    name = "concat('FX', lpad(cast(w.l_partkey as string), 6, '0'))"
    place = "24e0 + (w.l_partkey * 7213 % 25000) / 1e3 as lat, -125e0 + (w.l_partkey * 81799 % 58000) / 1e3 as lon"
    point = f"struct(i as seq, {name} as identifier, {name} as name, {place}, cast(null as double) as distanceToNextNm)"
    rows = listed.selectExpr("ord", "concat('V', cast(ord % 500 as string)) as designation", f"transform(items, (w, i) -> {point}) as waypoints")
    return rows
