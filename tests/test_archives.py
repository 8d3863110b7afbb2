"""ZIP archives, nested and large, and the builders that read them."""

import io
import zipfile

import pytest
from aerolake.operators.builders import registry, special_use
from aerolake.sources import archives, text
from pyspark.sql import functions as F

AREA = """<?xml version="1.0" encoding="UTF-8"?>
<saa:SaaMessage xmlns:saa="urn:a" xmlns:aixm="urn:b"><saa:hasMember><aixm:Airspace><aixm:timeSlice><aixm:AirspaceTimeSlice>
<aixm:name>{name}</aixm:name><aixm:designator>{name}</aixm:designator>
<aixm:geometryComponent><aixm:AirspaceGeometryComponent><aixm:operation>{operation}</aixm:operation><aixm:theAirspaceVolume><aixm:AirspaceVolume>
<aixm:upperLimit uom="FL">180</aixm:upperLimit><aixm:upperLimitReference>STD</aixm:upperLimitReference>
<aixm:lowerLimit uom="FT">{low}</aixm:lowerLimit><aixm:lowerLimitReference>SFC</aixm:lowerLimitReference>
<aixm:horizontalProjection><aixm:Surface><aixm:patches><aixm:PolygonPatch><aixm:exterior><aixm:Ring>{parts}</aixm:Ring></aixm:exterior></aixm:PolygonPatch></aixm:patches></aixm:Surface></aixm:horizontalProjection>
</aixm:AirspaceVolume></aixm:theAirspaceVolume></aixm:AirspaceGeometryComponent></aixm:geometryComponent>
<aixm:extension><aixm:AirspaceExtension><aixm:suaType>{kind}</aixm:suaType></aixm:AirspaceExtension></aixm:extension>
</aixm:AirspaceTimeSlice></aixm:timeSlice></aixm:Airspace></saa:hasMember></saa:SaaMessage>"""
LINE = "<curveMember><Curve><segments><LineStringSegment>{}</LineStringSegment></segments></Curve></curveMember>"
ARC = "<curveMember><Curve><segments><ArcByCenterPoint><pointProperty><Point><pos>-100 40</pos></Point></pointProperty>{}</ArcByCenterPoint></segments></Curve></curveMember>"


def pos(*points):
    return "".join(f"<pos>{lon} {lat}</pos>" for lon, lat in points)


SQUARE = [(-100, 40), (-99, 40), (-99, 41), (-100, 41)]


def area(name="A", kind="MOA", parts=LINE.format(pos(*SQUARE)), operation="BASE", low="0"):
    return AREA.format(name=name, kind=kind, parts=parts, operation=operation, low=low)


def build(spark, *documents):
    rows = spark.createDataFrame([(n, d) for n, d in enumerate(documents)], "n long, content string")
    return {r.n: r for r in special_use.build(rows).collect()}


def test_line_is_closed_and_a_closed_one_is_not_closed_again(spark):
    found = build(spark, area(), area(parts=LINE.format(pos(*SQUARE, SQUARE[0]))))
    assert [[tuple(p) for p in found[n].boundary[0]] for n in (0, 1)] == [[*SQUARE, SQUARE[0]]] * 2


def test_arcs_turn_on_from_their_start_and_parts_keep_their_order(spark):
    arc = ARC.format("<radius uom='NM'>60</radius><startAngle>270</startAngle><endAngle>90</endAngle>")
    ring = build(spark, area(parts=LINE.format(pos((-101, 39), (-100.5, 39))) + arc + LINE.format(pos((-101, 41)))))[0].boundary[0]
    assert [tuple(p) for p in ring[:2]] == [(-101, 39), (-100.5, 39)] and tuple(ring[-2]) == (-101, 41) and ring[-1] == ring[0]
    assert len(ring) == 2 + 65 + 1 + 1
    assert ring[2] == pytest.approx([-100, 39]) and ring[2 + 32] == pytest.approx([-100 + 1 / 0.7660444431, 40]) and ring[2 + 64] == pytest.approx([-100, 41])


def test_broken_parts_and_documents_are_left_out(spark):
    half = ARC.format("<radius>5</radius><startAngle>0</startAngle>")
    found = build(
        spark, area(parts=half), area(parts=half + LINE.format(pos(*SQUARE) + "<pos>1</pos><pos>x y</pos>")), area(kind="NONE"), area(parts=LINE.format(pos(*SQUARE[:3]))),
        "<not xml", None, "", "<a/>", area(operation="SUBTR"), area(parts=""),
    )
    assert sorted(found) == [1, 8] and len(found[1].boundary[0]) == 5


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return out.getvalue()


def test_areas_of_an_archive_within_an_archive(spark, tmp_path):
    inner = zipped({f"saa/{k}.xml": area(k) for k in "ABC"} | {"readme.txt": "none"})
    (tmp_path / "outer.zip").write_bytes(zipped({"Saa_Sub_File.zip": inner, "folder/": ""}))
    found = special_use.build(archives.documents(spark, str(tmp_path), r"\.xml$")).collect()
    assert sorted((r.member, r.identifier) for r in found) == [(f"Saa_Sub_File.zip/saa/{k}.xml", k) for k in "ABC"]


def test_a_member_larger_than_a_batch(spark, tmp_path):
    values = [f"line {n}" if n % 1000 else "x" * 5000 for n in range(20_000)]
    (tmp_path / "a.zip").write_bytes(zipped({"big.txt": "\r\n".join(values) + "\r\n", "empty.txt": "", "other.bin": "\n"}))
    read = archives.lines(spark, str(tmp_path / "a.zip"), r"\.txt$", batch=4096)
    assert [(r.ord, r.value) for r in sorted(read.collect(), key=lambda r: r.ord)] == list(enumerate(values))
    assert archives.lines(spark, str(tmp_path / "a.zip"), "nothing").collect() == []


def test_separated_values_by_the_header_of_each_member(spark, tmp_path):
    one = '﻿NAME,ID\n"a, ""b""",1\n\n plain , 2 \n'
    two = "ID,OTHER,NAME\n3,x,c\n4\n"
    (tmp_path / "a.zip").write_bytes(zipped({"one.csv": one, "sub/two.CSV": two}))
    found = archives.csv(spark, str(tmp_path / "a.zip"), r"\.csv$", ["ID", "name"])
    assert sorted((r.ID, r.name) for r in found.collect()) == [("1", 'a, "b"'), ("2", "plain"), ("3", "c"), ("4", None)]


def test_registry_reads_archives_as_it_reads_files(spark, tmp_path):
    master = "N-NUMBER,SERIAL NUMBER,MFR MDL CODE,YEAR MFR,NAME,TYPE AIRCRAFT,TYPE ENGINE,MODE S CODE HEX\n" + "".join(f"{n},S,{n % 3},19{n % 90 + 10},OWNER {n},4,1,A{n:05X}  \n" for n in range(200))
    models = "CODE,MFR,MODEL\n0,CESSNA,172\n1,PIPER,PA28\n"
    for name, content in {"MASTER.txt": master, "ACFTREF.txt": models}.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "all.zip").write_bytes(zipped({"MASTER.txt": master, "ACFTREF.txt": models}))
    columns = {name: content.split("\n")[0].split(",") for name, content in {"MASTER.txt": master, "ACFTREF.txt": models}.items()}

    def built(read):
        return sorted(map(str, registry.build(read("MASTER.txt"), read("ACFTREF.txt")).drop("ord").collect()))

    from_archive = built(lambda name: archives.csv(spark, str(tmp_path / "all.zip"), name, columns[name], quoted=False).drop("archive", "member"))
    assert len(from_archive) == 200 and from_archive == built(lambda name: text.csv(spark, str(tmp_path / name), quoted=False))
