"""Great circles on a sphere of 3440.065 NM radius, and planar tests on rings of [lon, lat] points."""

from __future__ import annotations

from .sqlfn import fn

_POINT = "STRUCT<lat: DOUBLE, lon: DOUBLE>"
_BOX = "STRUCT<minLon: DOUBLE, maxLon: DOUBLE, minLat: DOUBLE, maxLat: DOUBLE>"
_RING = "ARRAY<ARRAY<DOUBLE>>"
_POLYGON = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
_HAVERSINE = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"


def _wrap(degrees: str) -> str:
    return f"(({degrees}) + 540) % 360 - 180"


def _inside(x: str, y: str, ring: str) -> str:
    """Even-odd test: each edge joins a vertex to the one before it, and flips the result where the ray crosses it."""
    before = f"concat(slice({ring}, size({ring}), 1), slice({ring}, 1, size({ring}) - 1))"
    crosses = f"({y} < p[1]) <> ({y} < q[1]) AND {x} < (q[0] - p[0]) * ({y} - p[1]) / nullif(q[1] - p[1], 0D) + p[0]"
    return f"aggregate(zip_with({ring}, {before}, (p, q) -> coalesce({crosses}, false)), false, (odd, hit) -> odd <> hit)"


def _arc_angle() -> str:
    return "radians(start_deg + i / steps * (end_deg - start_deg + CASE WHEN end_deg <= start_deg THEN 360 ELSE 0 END))"


FUNCTIONS = [
    fn("normalize_deg", "x", "pmod(x, 360D)"),
    fn("arc_nm", "a", "3440.065D * 2 * atan2(sqrt(a), sqrt(1 - a))"),
    fn("distance_nm", "lat1, lon1, lat2, lon2", f"arc_nm({_HAVERSINE})"),
    fn(
        "bearing_deg",
        "lat1, lon1, lat2, lon2",
        """pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
            cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360D)""",
    ),
    fn(
        "bearing_and_distance",
        "lat1, lon1, lat2, lon2",
        "named_struct('bearingDeg', bearing_deg(lat1, lon1, lat2, lon2), 'distanceNm', distance_nm(lat1, lon1, lat2, lon2))",
        "STRUCT<bearingDeg: DOUBLE, distanceNm: DOUBLE>",
    ),
    fn(
        "midpoint",
        "lat1, lon1, lat2, lon2",
        f"""named_struct('lat', degrees(atan2(sin(radians(lat1)) + sin(radians(lat2)), sqrt(
                pow(cos(radians(lat1)) + cos(radians(lat2)) * cos(radians(lon2 - lon1)), 2) + pow(cos(radians(lat2)) * sin(radians(lon2 - lon1)), 2)))),
            'lon', {_wrap('''degrees(radians(lon1) + atan2(cos(radians(lat2)) * sin(radians(lon2 - lon1)),
                cos(radians(lat1)) + cos(radians(lat2)) * cos(radians(lon2 - lon1))))''')})""",
        _POINT,
    ),
    fn("destination_lat", "lat, bearing, nm", "degrees(asin(sin(radians(lat)) * cos(nm / 3440.065D) + cos(radians(lat)) * sin(nm / 3440.065D) * cos(radians(bearing))))"),
    fn(
        "destination",
        "lat, lon, bearing, nm",
        f"""named_struct('lat', destination_lat(lat, bearing, nm), 'lon', {_wrap('''degrees(radians(lon) + atan2(
            sin(radians(bearing)) * sin(nm / 3440.065D) * cos(radians(lat)),
            cos(nm / 3440.065D) - sin(radians(lat)) * sin(radians(destination_lat(lat, bearing, nm)))))''')})""",
        _POINT,
    ),
    fn("point_in_ring", f"x, y, ring {_RING}", _inside("x", "y", "ring"), "BOOLEAN"),
    fn(
        "point_in_polygon",
        f"x, y, polygon {_POLYGON}",
        f"{_inside('x', 'y', 'polygon[0]')} AND NOT exists(slice(polygon, 2, size(polygon)), hole -> {_inside('x', 'y', 'hole')})",
        "BOOLEAN",
    ),
    fn(
        "ring_bounding_box",
        f"ring {_RING}",
        """named_struct('minLon', array_min(transform(ring, p -> p[0])), 'maxLon', array_max(transform(ring, p -> p[0])),
            'minLat', array_min(transform(ring, p -> p[1])), 'maxLat', array_max(transform(ring, p -> p[1])))""",
        _BOX,
    ),
    fn("polygon_bounding_box", f"polygon {_POLYGON}", "ring_bounding_box(flatten(polygon))", _BOX),
    fn("point_in_box", f"lon, lat, box {_BOX}", "lon BETWEEN box.minLon AND box.maxLon AND lat BETWEEN box.minLat AND box.maxLat", "BOOLEAN"),
    fn("boxes_overlap", f"a {_BOX}, b {_BOX}", "a.minLon <= b.maxLon AND a.maxLon >= b.minLon AND a.minLat <= b.maxLat AND a.maxLat >= b.minLat", "BOOLEAN"),
    fn(
        "polygon_centroid",
        f"polygon {_POLYGON}",
        """CASE WHEN size(polygon[0]) > 0 THEN array(aggregate(polygon[0], 0D, (s, p) -> s + p[0]) / size(polygon[0]),
            aggregate(polygon[0], 0D, (s, p) -> s + p[1]) / size(polygon[0])) END""",
        "ARRAY<DOUBLE>",
    ),
    fn("polygons_identical", f"a {_POLYGON}, b {_POLYGON}", "a = b", "BOOLEAN"),
    fn(
        "polygons_overlap",
        f"a {_POLYGON}, b {_POLYGON}",
        """polygons_identical(a, b) OR point_in_polygon(polygon_centroid(a)[0], polygon_centroid(a)[1], b)
            OR point_in_polygon(polygon_centroid(b)[0], polygon_centroid(b)[1], a)""",
        "BOOLEAN",
    ),
    fn("close_ring", f"ring {_RING}", "CASE WHEN size(ring) = 0 OR ring[0] = ring[size(ring) - 1] THEN ring ELSE concat(ring, slice(ring, 1, 1)) END", _RING),
    fn("open_ring", f"ring {_RING}", "CASE WHEN size(ring) > 1 AND ring[0] = ring[size(ring) - 1] THEN slice(ring, 1, size(ring) - 1) ELSE ring END", _RING),
    fn("round_ring", f"ring {_RING}", "transform(ring, p -> transform(p, v -> floor(v * 1e5 + 0.5) / 1e5))", _RING),
    # flat earth: a degree is 60 NM, narrowed by the centre's latitude; angles from east, counterclockwise
    fn(
        "discretize_arc",
        "lon, lat, radius_nm, start_deg, end_deg, steps INT DEFAULT 64",
        f"""transform(sequence(0, steps), i -> array(
            lon + cos({_arc_angle()}) * radius_nm / 60 / coalesce(nullif(cos(radians(lat)), 0D), 1D), lat + sin({_arc_angle()}) * radius_nm / 60))""",
        _RING,
    ),
]
