"""Published record formats written from the driver's tables, so that builders have files to read.

The SQL beside each query says what the built rows must be from the tables themselves, never from
the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import settled


def fixed(width: int, *places: tuple[int, int, str, str]) -> str:
    """SQL of a record of `width` columns: (first column, width, 'l' or 'r' for the side of the text, SQL)."""
    parts, at = [], 1
    for start, size, side, sql in sorted(places):
        if start > at:
            parts.append(f"repeat(' ', {start - at})")
        pad = "rpad" if side == "l" else "lpad"
        parts.append(f"{pad}(coalesce(cast({sql} as string), ''), {size}, ' ')")
        at = start + size
    parts.append(f"repeat(' ', {width + 1 - at})")
    return f"concat({', '.join(parts)})"


def dms(table_value: str, positive: str, negative: str, digits: int) -> str:
    """SQL of a position as degrees-minutes-seconds from whole seconds."""
    s = f"abs({table_value})"
    return f"concat(lpad(cast({s} div 3600 as string), {digits}, '0'), '-', lpad(cast({s} div 60 % 60 as string), 2, '0'), '-', lpad(cast({s} % 60 as string), 2, '0'), '.00', case when {table_value} < 0 then '{negative}' else '{positive}' end)"


def packed(table_value: str, positive: str, negative: str, digits: int) -> str:
    """SQL of a position as hemisphere, degrees, minutes and hundredths of seconds, without marks, from whole seconds."""
    s = f"abs({table_value})"
    return f"concat(case when {table_value} < 0 then '{negative}' else '{positive}' end, lpad(cast({s} div 3600 as string), {digits}, '0'), lpad(cast({s} div 60 % 60 as string), 2, '0'), lpad(cast({s} % 60 as string), 2, '0'), '00')"


_LAT, _LON = "(86400 + p_partkey * 7213 % 90000)", "(-450000 + p_partkey * 8179 % 200000)"
_WAY = "p_partkey div 10"
_LETTER = f"substring('VJQTGRABX', cast({_WAY} % 9 as int) + 1, 1)"
_AREA = f"case when {_WAY} % 5 = 0 then 'A' when {_WAY} % 5 = 1 then 'H' else '' end"
_KIND = "case p_partkey % 4 when 0 then 'VORTAC' when 1 then 'REP-PT' when 2 then 'WAY-PT' else '' end"
_POINT_NAME = "case when p_partkey % 8 = 3 then 'U.S. CANADIAN BORDER' else concat('PT', p_partkey) end"
# five columns of a designation: a letter and the airway's number in base 36, 36^4 of them
_KEY = ((5, 5, "l", f"concat({_LETTER}, conv({_WAY}, 10, 36))"), (10, 1, "l", _AREA), (11, 5, "r", "p_partkey % 10 * 10"))

AWY1 = fixed(
    302, (1, 4, "l", "'AWY1'"), *_KEY, (45, 6, "r", "case when p_partkey % 3 > 0 then p_partkey % 90 end"), (57, 6, "r", "p_partkey % 360"), (63, 6, "r", "(p_partkey + 180) % 360"),
    (69, 6, "r", "p_partkey % 50 + 0.5"), (75, 5, "r", "p_partkey % 12 * 1000 + 1000"), (80, 6, "l", "case when p_partkey % 6 = 0 then 'NE BND' end"), (97, 5, "r", "17500"),
    (107, 1, "l", "case when p_partkey % 11 = 0 then 'X' end"), (135, 1, "l", "case when p_partkey % 7 = 0 then 'Y' else 'N' end"), (142, 3, "l", "'ZNY'"), (302, 1, "l", "case when p_partkey % 13 = 0 then 'Y' end"),
)
AWY2 = fixed(
    130, (1, 4, "l", "'AWY2'"), *_KEY, (16, 30, "l", _POINT_NAME), (46, 19, "l", _KIND), (80, 2, "l", "'NY'"), (82, 2, "l", "'K6'"),
    (84, 14, "l", f"case when p_partkey % 17 > 0 then {dms(_LAT, 'N', 'S', 2)} end"), (98, 14, "l", dms(_LON, "E", "W", 3)), (112, 5, "r", "p_partkey % 5 * 500"), (117, 4, "l", "case when p_partkey % 4 = 0 then concat('V', p_partkey % 999) end"),
)

_ROUTE = "s_suppkey div 4"
_PREFIX = f"case {_ROUTE} % 5 when 0 then 'AT' when 1 then 'BF' when 2 then 'PA' when 3 then 'PR' else 'XX' end"
_ATS_KEY = ((5, 2, "l", _PREFIX), (7, 12, "l", f"concat('R', {_ROUTE})"), (21, 5, "r", "s_suppkey % 4 * 10 + 10"))
ATS1 = fixed(350, (1, 4, "l", "'ATS1'"), *_ATS_KEY, (55, 6, "r", "s_suppkey % 80"), (85, 5, "r", "s_suppkey % 9 * 1000"), (148, 1, "l", "case when s_suppkey % 3 = 0 then 'Y' end"))
ATS2 = fixed(
    160, (1, 4, "l", "'ATS2'"), *_ATS_KEY, (26, 40, "l", "concat('OP', s_suppkey)"), (66, 25, "l", "case when s_suppkey % 2 = 0 then 'NDB/DME' else 'MIL-REP-PT' end"),
    (110, 14, "l", dms("(36000 + s_suppkey * 613 % 90000)", "N", "S", 2)), (124, 14, "l", dms("(-300000 + s_suppkey * 9282 % 90000)", "E", "W", 3)), (143, 4, "l", "case when s_suppkey % 2 = 0 then concat('N', s_suppkey % 500) end"),
)


def _written(lines: DataFrame) -> DataFrame:
    """The lines behind a shuffle and a step, as if read from a file: their text is put together once, not for every field or filter."""
    dealt = lines.repartition("ord")
    return settled(dealt.withColumnRenamed("value", "line"), F.col("line").alias("value")).drop("line")


def airway_lines(spark: SparkSession) -> DataFrame:
    """Federal and oceanic route records, the federal second record of each segment before the first."""
    return _written(spark.sql(f"select p_partkey * 2 as ord, {AWY2} as value from part union all select p_partkey * 2 + 1, {AWY1} from part"))


def oceanic_lines(spark: SparkSession) -> DataFrame:
    return _written(spark.sql(f"select s_suppkey * 2 as ord, {ATS1} as value from supplier where s_suppkey % 7 > 0 union all select s_suppkey * 2 + 1, {ATS2} from supplier"))


_TYPE = "case o % 3 when 0 then 'D' when 1 then 'E' else 'F' end"
# of an approach the airport's four columns and two of its identifier's six hold the order's number in base 36: 36^6 of them
_IDENT = "case o % 3 when 0 then concat('D', o div 1000) when 1 then concat('A', o div 1000) else concat('I', lpad(cast(1 + o % 36 as string), 2, '0'), case when o % 4 = 0 then 'L' else '-' end, conv(o div 1679616, 10, 36)) end"
_ROUTE_TYPE = "case when o % 3 = 2 then case when k <= 2 then 'A' else 'I' end else case when k <= 2 then '4' else '2' end end"
LEG = fixed(
    132, (1, 1, "l", "'S'"), (5, 1, "l", "'P'"), (7, 4, "l", "case when o % 3 = 2 then conv(o % 1679616, 10, 36) else concat('K', o % 1000) end"), (11, 2, "l", "'K6'"), (13, 1, "l", _TYPE), (14, 6, "l", _IDENT),
    (20, 1, "l", _ROUTE_TYPE), (21, 5, "l", "case when k <= 2 then concat('TR', k) end"), (27, 3, "r", "lpad(cast(k * 10 as string), 3, '0')"),
    (30, 5, "l", "case when k % 2 = 0 then concat('N', (o + k) % 30) else concat('F', (o * 31 + k) % 3000) end"), (35, 2, "l", "'K6'"), (37, 2, "l", "case when k % 2 = 0 then 'D ' else 'EA' end"),
    (39, 1, "l", "case when o % 50 = 0 and k = 4 then '2' else '0' end"),
    (40, 4, "l", "concat('E', case when k = 3 then 'Y' else ' ' end, case when k = 6 then 'M' else ' ' end, case k when 1 then 'A' when 4 then 'F' when 5 then 'M' else ' ' end)"),
    (44, 1, "l", "case k % 3 when 0 then 'L' when 1 then 'R' end"), (45, 3, "l", "case when k = 3 then '303' end"), (48, 2, "l", "case when k = 7 then 'HM' when k = 1 then 'IF' else 'TF' end"),
    (71, 4, "r", "concat(lpad(cast(o % 360 as string), 3, '0'), case when o % 5 = 0 then 'T' else '' end)"), (75, 4, "l", "case when k = 7 then 'T010' else lpad(cast(o % 400 as string), 4, '0') end"),
    (83, 1, "l", "case when k = 3 then '+' when k = 5 then 'Z' end"), (85, 5, "l", "case when o % 2 = 0 then 'FL180' else '05000' end"), (100, 3, "r", "case when k = 3 then '210' end"),
)


def _region(number: str) -> str:
    """SQL of a region's two columns for what an identifier's columns have no room for: K6 for 0, and 1,295 others."""
    return f"lpad(conv(({number} + 726) % 1296, 10, 36), 2, '0')"


FIX = fixed(132, (1, 1, "l", "'S'"), (5, 2, "l", "'EA'"), (14, 5, "l", "concat('F', p_partkey % 10000)"), (20, 2, "l", _region("p_partkey div 10000")), (22, 1, "l", "'0'"), (33, 9, "l", packed(_LAT, "N", "S", 2)), (42, 10, "l", packed(_LON, "E", "W", 3)))
STATION = fixed(
    132, (1, 1, "l", "'S'"), (5, 1, "l", "'D'"), (14, 4, "l", "concat('N', s_suppkey % 1000)"), (20, 2, "l", _region("s_suppkey div 1000")), (22, 1, "l", "'0'"),
    (56, 9, "l", packed("(36000 + s_suppkey * 613 % 90000)", "N", "S", 2)), (65, 10, "l", packed("(-300000 + s_suppkey * 9282 % 90000)", "E", "W", 3)),
)


def _dealt(spark: SparkSession, table: str, key: str) -> DataFrame:
    """A table's keys, dealt to all cores and to no fewer tasks than the table has splits."""
    keys = spark.table(table).select(key)
    return keys.repartition(max(2 * spark.sparkContext.defaultParallelism, keys.rdd.getNumPartitions()), key)


def procedure_lines(spark: SparkSession) -> DataFrame:
    """Seven legs of one procedure per order, of which the fixes are parts and the navaids suppliers.

    The keys are dealt, not the lines, which are twenty times as long and are put together once in each task.
    """
    orders, parts, suppliers = _dealt(spark, "orders", "o_orderkey"), _dealt(spark, "part", "p_partkey"), _dealt(spark, "supplier", "s_suppkey")
    lines = orders.select(F.col("o_orderkey").alias("o"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).selectExpr("o * 10 + k as ord", f"{LEG} as line")
    fixes = parts.selectExpr("10000000000 + p_partkey as ord", f"{FIX} as line")
    stations = suppliers.selectExpr("20000000000 + s_suppkey as ord", f"{STATION} as line")
    return settled(lines.unionAll(fixes).unionAll(stations), F.col("line").alias("value"), apart=True).drop("line")


def element(name: str, *content: str, **attributes: str) -> str:
    """SQL of an XML element around the SQL of its content."""
    marks = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f"concat('<{name}{marks}>', {', '.join(content)}, '</{name}>')"


def within(path: str, *content: str) -> str:
    """SQL of nested elements, the outermost first."""
    first, _, rest = path.partition(" ")
    return element(first, within(rest, *content)) if rest else element(first, *content)


def _position(lon: str, lat: str) -> str:
    return element("pos", f"{lon}, ' ', {lat}")


_C = "c_custkey"
_CORNERS = [_position(f"{_C} % 50 - 120 + {x}", f"{_C} % 20 + 25 + {y}") for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
_CENTRE = within("pointProperty Point", _CORNERS[0])
_RADIUS_NM = f"concat('<radius uom=\"NM\">', {_C} % 9 + 1, '</radius>')"
_RADIUS_FT = f"concat('<radius uom=\"FT\">', ({_C} % 9 + 1) * 1000, '</radius>')"
_ARC = within("curveMember Curve segments ArcByCenterPoint", _CENTRE, _RADIUS_NM, element("startAngle", f"{_C} % 360", uom="deg"), element("endAngle", f"{_C} * 7 % 360", uom="deg"))
_SIDE = within("curveMember Curve segments LineStringSegment", f"case when {_C} % 23 = 0 then '' else {_CORNERS[0]} end", _CORNERS[1])
_OUTLINE = f"""case when {_C} % 3 = 0 then {element('LinearRing', *_CORNERS[:2], f"case when {_C} % 23 = 0 then '' else concat({_CORNERS[2]}, {_CORNERS[3]}) end")}
    when {_C} % 3 = 1 then {element('Ring', _SIDE, _ARC)} else {element('Ring', within('curveMember Curve segments CircleByCenterPoint', _CENTRE, _RADIUS_FT))} end"""
_LOWER = f"""case when {_C} % 19 = 0 then '<lowerLimit uom="OTHER">BY NOTAM</lowerLimit>' when {_C} % 3 = 0 then '<lowerLimit uom="FT">GND</lowerLimit>'
    when {_C} % 3 = 1 then '<lowerLimit uom="FT">500</lowerLimit><lowerLimitReference>AGL</lowerLimitReference>' else '<lowerLimit uom="FT">1200</lowerLimit><lowerLimitReference>MSL</lowerLimitReference>' end"""
_UPPER = f"""case when {_C} % 2 = 0 then '<upperLimit uom="OTHER">UNL</upperLimit><upperLimitReference>OTHER</upperLimitReference>' else '<upperLimit uom="FL">180</upperLimit><upperLimitReference>STD</upperLimitReference>' end"""
_PARTS = [
    within("geometryComponent AirspaceGeometryComponent operation", "'SUBTR'"),
    within("geometryComponent AirspaceGeometryComponent", "'<operation>BASE</operation>'", within("theAirspaceVolume AirspaceVolume", _UPPER, _LOWER, within("horizontalProjection Surface patches PolygonPatch exterior", _OUTLINE))),
]
_NOTE = f"""case when {_C} % 5 = 0 then '' else concat('<annotation><Note><propertyName>legalDefinitionType</propertyName><translatedNote><LinguisticNote><note>Boundaries. Around &amp; about.\\nTimes of use. Day ', {_C} % 7,
    '.\\nControlling agency. FAA.</note></LinguisticNote></translatedNote></Note></annotation>') end"""
_AREA_KIND = f"case when {_C} % 17 = 0 then 'XYZ' else element_at(array('MOA', 'RA', 'WA', 'AA', 'PA', 'NSA'), cast({_C} % 6 + 1 as int)) end"
_EXTENSIONS = [within("extension AirspaceExtension administrativeArea", f"element_at(array('New York', 'TEXAS', 'Nowhere'), cast({_C} % 3 + 1 as int))"), within("extension AirspaceExtension suaType", _AREA_KIND)]
_SLICE = [element("name", f"concat('AREA ', {_C})"), element("designator", f"concat('S', {_C})"), *_PARTS, _NOTE, *_EXTENSIONS]
SPECIAL_USE = element(
    "SaaMessage", within("hasMember Unit timeSlice UnitTimeSlice", "'<type>TOWER</type><designator>TWR</designator>'"), within("hasMember Airspace timeSlice AirspaceTimeSlice", *_SLICE),
    within("hasMember Unit timeSlice UnitTimeSlice", f"'<type>ARTCC</type><designator>Z', c_nationkey, '</designator>'"), xmlns="urn:saa",
)


def special_use_documents(spark: SparkSession) -> DataFrame:
    """A special-use area per customer: squares, lines with an arc, and circles."""
    return spark.sql(f"select {_C} as ord, {SPECIAL_USE} as content from customer").repartition("ord")
