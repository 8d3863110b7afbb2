"""Polygon shape files: a data source that splits them by their index, and a writer of one file per task and size.

A shape file is three: geometry records (.shp), their places (.shx) and a table of attributes (.dbf) with
a record for each. A partition is a range of record numbers; it reads its part of the index, then the
stretch of geometry and of the table that belong to it, and nothing else. Addresses are local
paths or what pyarrow's file systems open (file:, hdfs:, s3:, ...).
"""

from __future__ import annotations

import os
import struct
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

#: Bytes of geometry in a partition that is read, and of geometry and attributes in a file that is written.
SPLIT = 32 << 20
FILE = 32 << 20
#: Records of a batch.
_BATCH = 1000

# Fixed values of the format: its number and version, and the kinds of geometry that are polygons.
_MAGIC, _VERSION = 9994, 1000
_NULL, _POLYGONS = 0, (5, 15, 25)
_WIDEST = 254

Polygon = list[np.ndarray]
_NESTED = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
_ARROW = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """Geometry files at a path or in the folder there, without their ending, and their sizes."""
    system, place = _opened(path)
    found = system.get_file_info(place)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted((i.path[:-4], i.size) for i in infos if i.path.lower().endswith(".shp"))


@dataclass(frozen=True)
class Table:
    """Layout of an attribute table."""

    rows: int
    header: int
    width: int
    fields: tuple[tuple[str, int, int], ...]  # name, place in a record, size

    @staticmethod
    def read(file: pa.NativeFile) -> Table:
        head = file.read(32)
        rows, header, width = struct.unpack("<IHH", head[4:12])
        fields, at = [], 1
        for n in range((header - 33) // 32):
            part = file.read(32)
            if part[:1] == b"\r":
                break
            fields.append((part[:11].split(b"\0")[0].decode("ascii", "replace"), at, part[16]))
            at += part[16]
        return Table(rows, header, width, tuple(fields))

    def columns(self, raw: bytes, encoding: str) -> list[list[str | None]]:
        """Each field of the records in `raw`, outer blanks gone and blank ones null."""
        records = [raw[n : n + self.width] for n in range(0, len(raw), self.width)]
        return [[r[at : at + size].decode(encoding, "replace").strip(" \0") or None for r in records] for _, at, size in self.fields]


def rings(record: bytes) -> list[np.ndarray] | None:
    """Rings of a polygon record as arrays of (x, y); None of a record without geometry."""
    kind = struct.unpack_from("<i", record)[0]
    if kind == _NULL:
        return None
    if kind not in _POLYGONS:
        raise ValueError(f"geometry of kind {kind} is not a polygon")
    parts, points = struct.unpack_from("<ii", record, 36)
    begin = np.frombuffer(record, "<i4", parts, 44)
    xy = np.frombuffer(record, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    return np.split(xy, begin[1:])


def _turn(ring: np.ndarray) -> float:
    """Twice the area, positive of a ring that runs counterclockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y))


def _holds(ring: np.ndarray, points: np.ndarray) -> bool:
    """Whether any of the points lies in the ring."""
    (x1, y1), (x2, y2) = ring.T, np.roll(ring, -1, 0).T
    x, y = points[:, :1], points[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return bool((crossed.sum(1) % 2 == 1).any())


def polygons(found: list[np.ndarray]) -> list[Polygon]:
    """Rings sorted into polygons: clockwise ones are outlines, the others holes of the first outline around them, or else outlines too."""
    out = [[r] for r in found if len(r) and _turn(r) <= 0]
    outlines = len(out)
    for hole in (r for r in found if len(r) and _turn(r) > 0):
        around = next((p for p in out[:outlines] if _holds(p[0], hole)), None)
        if around is None:
            out.append([hole])
        else:
            around.append(hole)
    return out


@dataclass
class Range(InputPartition):
    stem: str
    first: int
    last: int


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, split: int, encoding: str, names: list[str]):
        self.path, self.split, self.encoding, self.names = path, split, encoding, names

    def partitions(self) -> list[Range]:
        """Ranges of record numbers of about `split` bytes of geometry."""
        system, _ = _opened(self.path)
        out = []
        for stem, size in _files(self.path):
            records = (system.get_file_info(f"{stem}.shx").size - 100) // 8
            step = max(1, records * self.split // max(1, size))
            out += [Range(stem, at, min(records, at + step)) for at in range(0, records, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        stem = partition.stem
        with system.open_input_file(f"{stem}.shx") as index, system.open_input_file(f"{stem}.shp") as shapes, system.open_input_file(f"{stem}.dbf") as attributes:
            table = Table.read(attributes)
            place = {name: n for n, (name, _, _) in enumerate(table.fields)}
            for first in range(partition.first, partition.last, _BATCH):
                last = min(partition.last, first + _BATCH)
                index.seek(100 + 8 * first)
                starts, sizes = 2 * np.frombuffer(index.read(8 * (last - first)), ">i4").reshape(-1, 2).T.astype(np.int64)
                begin, end = int(starts.min()), int((starts + sizes).max()) + 8
                shapes.seek(begin)
                raw = shapes.read(end - begin)
                found = [rings(raw[a + 8 - begin : a + 8 - begin + n]) for a, n in zip(starts.tolist(), sizes.tolist())]
                attributes.seek(table.header + first * table.width)
                columns = table.columns(attributes.read((last - first) * table.width), self.encoding)
                values = [pa.array(columns[place[c]] if c in place else [None] * (last - first), pa.string()) for c in self.names]
                geometry = pa.array([None if r is None else [[ring.tolist() for ring in p] for p in polygons(r)] for r in found], _ARROW)
                numbers = pa.array(range(first, last), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(stem)] * len(found)), numbers, *values, geometry], ["file", "ord", *self.names, "polygons"])


class ShapeFiles(DataSource):
    """spark.read.format("shapes").load(path): file, ord, the attributes as text, and polygons as lists of rings of (x, y).

    Options: split (bytes), encoding. The attributes are those of the first file's table.
    """

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> T.StructType:
        system, _ = _opened(self.options["path"])
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no shape file at {self.options['path']}")
        with system.open_input_file(f"{files[0][0]}.dbf") as attributes:
            names = [name for name, _, _ in Table.read(attributes).fields]
        plain = [T.StructField("file", T.StringType()), T.StructField("ord", T.LongType()), *[T.StructField(c, T.StringType()) for c in names]]
        return T.StructType([*plain, T.StructField("polygons", _NESTED)])

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("encoding", "utf-8"), schema.names[2:-1])


def read(spark: SparkSession, path: str, split: int = SPLIT, encoding: str = "utf-8") -> DataFrame:
    """The features of the shape file at a path, or of all in a folder."""
    spark.dataSource.register(ShapeFiles)
    return spark.read.format("shapes").option("split", str(split)).option("encoding", encoding).load(path)


def _header(size: int, boxes: np.ndarray) -> bytes:
    box = [*boxes[:, :2].min(0), *boxes[:, 2:].max(0)] if len(boxes) else [0.0] * 4
    return struct.pack(">7i", _MAGIC, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", _VERSION, _POLYGONS[0], *box, 0, 0, 0, 0)


def _record(shape: list | None) -> tuple[bytes, list[float] | None]:
    found = [np.asarray(ring, np.float64).reshape(-1, 2) for polygon in shape or [] for ring in polygon]
    if not found:
        return struct.pack("<i", _NULL), None
    xy = np.concatenate(found)
    begin = np.cumsum([0, *map(len, found)])[:-1]
    box = [*xy.min(0).tolist(), *xy.max(0).tolist()]
    return struct.pack("<i4d2i", _POLYGONS[0], *box, len(found), len(xy)) + begin.astype("<i4").tobytes() + xy.astype("<f8").tobytes(), box


class _Cells:
    """Values of one attribute as their bytes, one after another, and where each ends."""

    def __init__(self):
        self.text, self.ends, self.widest = bytearray(), array("q"), 1

    def add(self, value: str | None) -> int:
        cell = (value or "").encode()
        self.text += cell
        self.ends.append(len(self.text))
        self.widest = max(self.widest, len(cell))
        return len(cell)

    def padded(self, first: int, last: int) -> np.ndarray:
        """Values first to last as rows of bytes of one width, blanks behind them."""
        bounds = np.frombuffer(self.ends, np.int64)
        bounds = np.append(bounds[first - 1] if first else 0, bounds[first:last])
        starts, lengths = bounds[:-1], np.diff(bounds)
        out = np.full((last - first, self.widest), ord(" "), np.uint8)
        row = np.repeat(np.arange(last - first), lengths)
        out[row, np.arange(bounds[0], bounds[-1]) - starts[row]] = np.frombuffer(self.text, np.uint8)[bounds[0] : bounds[-1]]
        return out


class _File:
    """A file that is being put together, as the bytes that it will have rather than as values."""

    def __init__(self, names: list[str]):
        self.names, self.cells, self.body, self.sizes, self.boxes, self.size = names, [_Cells() for _ in names], bytearray(), array("q"), array("d"), 0

    def add(self, values: list[str | None], shape: list | None) -> None:
        record, box = _record(shape)
        self.sizes.append(len(record))
        self.body += struct.pack(">2i", len(self.sizes), len(record) // 2) + record
        self.boxes.extend(box or ())
        self.size += len(record) + 8 + sum(c.add(v) for c, v in zip(self.cells, values))

    def table(self) -> Iterator[bytes]:
        sizes = [c.widest for c in self.cells]
        if any(n > _WIDEST for n in sizes):
            raise ValueError(f"an attribute is longer than {_WIDEST} bytes")
        fields = b"".join(name.encode("ascii").ljust(11, b"\0") + b"C" + bytes(4) + bytes([size]) + bytes(15) for name, size in zip(self.names, sizes))
        n = len(self.sizes)
        yield struct.pack("<4BIHH20x", 3, 100, 1, 1, n, 33 + len(fields), 1 + sum(sizes)) + fields + b"\r"
        for first in range(0, n, _BATCH):
            last = min(n, first + _BATCH)
            yield np.concatenate([np.full((last - first, 1), ord(" "), np.uint8), *[c.padded(first, last) for c in self.cells]], 1).tobytes()
        yield b"\x1a"

    def save(self, system: fs.FileSystem, stem: str) -> int:
        sizes = np.frombuffer(self.sizes, np.int64)
        places = 100 + np.cumsum(np.append(0, sizes + 8))
        boxes = np.frombuffer(self.boxes, np.float64).reshape(-1, 4)
        index = np.stack([places[:-1] // 2, sizes // 2], 1).astype(">i4").tobytes()
        for ending, content in ((".dbf", self.table()), (".shx", (_header(100 + len(index), boxes), index)), (".shp", (_header(100 + len(self.body), boxes), self.body))):
            with system.open_output_stream(stem + ending) as out:
                for part in content:
                    out.write(part)
        return len(sizes)


def write(features: DataFrame, path: str, file: int = FILE) -> int:
    """Write features to a folder: text columns of names of ten ASCII characters at most, and polygons. Returns their number.

    Every task writes files of its own, a new one after each `file` bytes of geometry and attributes, whose names
    depend on the partition alone: a task that is run again writes the same files again. Outlines
    must run clockwise and holes counterclockwise.
    """
    names = [c for c in features.columns if c != "polygons"]
    if any(len(c) > 10 or not c.isascii() for c in names):
        raise ValueError("attribute names have at most ten ASCII characters")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _opened(path)
        system.create_dir(place)
        part, number, written, growing = TaskContext.get().partitionId(), 0, 0, _File(names)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for n, shape in enumerate(batch.column("polygons")):
                growing.add([column[n] for column in columns], shape.as_py())
                if growing.size >= file:
                    written += growing.save(system, f"{place}/part-{part:05d}-{number:04d}")
                    growing, number = _File(names), number + 1
        if growing.sizes:
            written += growing.save(system, f"{place}/part-{part:05d}-{number:04d}")
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["n"])

    return features.mapInArrow(save, "n long").groupBy().sum("n").first()[0] or 0
