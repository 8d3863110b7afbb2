"""Shape files written, split by ranges of records and read back."""

import random
import struct
from pathlib import Path

import numpy as np
import pytest
from aerolake.operators.builders import airspace
from aerolake.sources import shapes

SCHEMA = "ID string, NAME string, polygons array<array<array<array<double>>>>"


def square(x, y, size=1.0, clockwise=True):
    corners = [[x, y], [x, y + size], [x + size, y + size], [x + size, y], [x, y]]
    return corners if clockwise else corners[::-1]


def features(n):
    rng = random.Random(4)
    out = []
    for i in range(n):
        x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
        kind = i % 4
        shape = [[square(x, y)]] if kind == 0 else [[square(x, y), square(x + 0.2, y + 0.2, 0.3, False)], [square(x + 5, y)]] if kind == 1 else [[square(x, y, 2.0), *[square(x + k / 4, y + 0.1, 0.1, False) for k in range(5)]]] if kind == 2 else None
        out.append((str(i), None if i % 5 == 0 else f"é {i} 名", shape))
    return out


def rows(df):
    return sorted((int(r.ID), r.NAME, r.polygons) for r in df.collect())


@pytest.mark.parametrize("split", [1, 700, 1 << 20])
def test_round_trip_in_ranges(spark, tmp_path, split):
    given = features(301)
    assert shapes.write(spark.createDataFrame(given, SCHEMA).repartition(3), str(tmp_path / "s"), file=4000) == 301
    files = list((tmp_path / "s").glob("*.shp"))
    assert len(files) > 6 and all(f.with_suffix(e).exists() for f in files for e in (".shx", ".dbf"))
    read = shapes.read(spark, str(tmp_path / "s"), split=split)
    assert rows(read) == sorted((int(a), b, c) for a, b, c in given)
    assert read.columns == ["file", "ord", "ID", "NAME", "polygons"]
    assert len({(r.file, r.ord) for r in read.select("file", "ord").collect()}) == 301


def test_partitions_are_ranges_of_one_file(spark, tmp_path):
    shapes.write(spark.createDataFrame(features(200), SCHEMA).coalesce(1), str(tmp_path / "s"))
    (file,) = (tmp_path / "s").glob("*.shp")
    reader = shapes.ShapeReader(str(file), file.stat().st_size // 7, "utf-8", ["ID"])
    parts = reader.partitions()
    assert len(parts) >= 7 and [p.first for p in parts[1:]] == [p.last for p in parts[:-1]] and parts[-1].last == 200
    (middle,) = reader.read(parts[3])
    assert middle.column("ord").to_pylist() == list(range(parts[3].first, parts[3].last))
    assert sorted(int(i) for p in parts for b in reader.read(p) for i in b.column("ID").to_pylist()) == list(range(200))


def test_header_follows_the_format(spark, tmp_path):
    shapes.write(spark.createDataFrame(features(9), SCHEMA).coalesce(1), str(tmp_path / "s"))
    (file,) = (tmp_path / "s").glob("*.shp")
    raw, index = file.read_bytes(), Path(file).with_suffix(".shx").read_bytes()
    assert struct.unpack(">i", raw[:4]) == (9994,) and struct.unpack(">i", raw[24:28])[0] * 2 == len(raw)
    assert struct.unpack("<ii", raw[28:36]) == (1000, 5) and struct.unpack(">i", index[24:28])[0] * 2 == len(index) == 100 + 8 * 9
    offset, size = struct.unpack(">ii", index[108:116])
    assert struct.unpack(">ii", raw[2 * offset : 2 * offset + 8]) == (2, size)


def test_rings_become_polygons():
    outer, hole, island, lost = (np.array(r) for r in (square(0, 0, 9.0), square(1, 1, 2.0, False), square(20, 0), square(50, 50, 1.0, False)))
    found = shapes.polygons([hole, outer, island, lost])
    assert [[r.tolist() for r in p] for p in found] == [[outer.tolist(), hole.tolist()], [island.tolist()], [lost.tolist()]]


def test_refuses_other_geometry_and_long_names(spark, tmp_path):
    with pytest.raises(ValueError, match="not a polygon"):
        shapes.rings(struct.pack("<i2d", 1, 0.0, 0.0))
    with pytest.raises(ValueError, match="ten ASCII"):
        shapes.write(spark.createDataFrame([("x", None)], "ELEVENLETTERS string, polygons array<array<array<array<double>>>>"), str(tmp_path / "x"))
    with pytest.raises(Exception, match="no shape file"):
        shapes.read(spark, str(tmp_path))


def test_attributes_fill_a_file_too(spark, tmp_path):
    given = [(str(i), "n" * (i % 200), None) for i in range(2500)]
    assert shapes.write(spark.createDataFrame(given, SCHEMA).coalesce(1), str(tmp_path / "a"), file=150_000) == 2500
    assert len(list((tmp_path / "a").glob("*.shp"))) == 2
    assert rows(shapes.read(spark, str(tmp_path / "a"))) == sorted((int(a), b or None, c) for a, b, c in given)


def test_empty(spark, tmp_path):
    assert shapes.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e")) == 0


def test_states_of_airports(spark):
    base = spark.createDataFrame([(1, "JFK", "NY"), (2, "JFK", " "), (3, "LAX", "XX"), (4, "LAX", "CA"), (5, " ", "TX"), (6, "ZZZ", None)], "ord long, ARPT_ID string, STATE_CODE string")
    assert sorted(map(tuple, airspace.airport_states(base).collect())) == [("JFK", "NY"), ("LAX", "CA")]


def test_class_areas_choose_kind_and_largest_polygon(spark):
    big = [[0.0, 0.0], [0.0, 1.0], [0.5, 1.00005], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]
    row = ("f", 1, "JFK", None, "0", "FT", "SFC", "-9998", "FT", "MSL", None, None, [[square(5.0, 5.0)[:4]], [big]])
    columns = "file string, ord long, IDENT string, NAME string, LOWER_VAL string, LOWER_UOM string, LOWER_CODE string, UPPER_VAL string, UPPER_UOM string, UPPER_CODE string, COMM_NAME string, WKHR_RMK string, polygons array<array<array<array<double>>>>, LOCAL_TYPE string"
    table = spark.createDataFrame([(*row, kind) for kind in ("CLASS_B", "CLASS_E4", "MODE C", None)], columns)
    found = {r.type: r for r in airspace.class_areas(table, spark.createDataFrame([("JFK", "NY")], "ARPT_ID string, state string")).collect()}
    assert sorted(found) == ["CLASS_B", "CLASS_E4"] and found["CLASS_B"].state == "NY" and found["CLASS_B"].name == ""
    assert found["CLASS_B"].boundary == found["CLASS_E4"].boundary == [[p for p in big if p[0] != 0.5]]
    assert (found["CLASS_B"].floor.reference, found["CLASS_B"].ceiling.valueFt) == ("SFC", 99999)
