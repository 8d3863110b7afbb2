"""Compressed JSON snapshots of datasets, and GeoJSON feature collections, as tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The records of a snapshot {"meta": {...}, "records": [...]}, one row each, in order as ord.

    The compression is told from the file's name. One file is one row before it is exploded; a
    large dataset should be many files or, better, line-delimited JSON read by Spark itself.
    """
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(T.StructType([T.StructField("records", T.ArrayType(T._parse_datatype_string(schema) if isinstance(schema, str) else schema))]))
    return reader.json(path).select(F.posexplode("records").alias("ord", "r")).select(F.col("ord").cast("long").alias("ord"), "r.*")


def meta(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a snapshot's meta data."""
    return spark.read.option("multiLine", True).json(path).select("meta.*")


def features(spark: SparkSession, path: str) -> DataFrame:
    """The polygons of a GeoJSON feature collection: ord, the properties, and boundary as rings of (lon, lat).

    Features of other kinds than Polygon are left out.
    """
    read_ = spark.read.option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    polygon = read_.where("f.geometry.type = 'Polygon'")
    return polygon.select(F.col("ord").cast("long").alias("ord"), "f.properties.*", F.col("f.geometry.coordinates").alias("boundary"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as compressed line-delimited JSON, each task its own file; null fields are left out."""
    records.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", True).json(path)


def write_features(areas: DataFrame, path: str, boundary: str = "boundary", digits: int = 5, compression: str = "gzip") -> None:
    """Areas as line-delimited GeoJSON features, their coordinates rounded."""
    ring = F.transform(boundary, lambda r: F.transform(r, lambda p: F.transform(p, lambda x: F.round(x, digits))))
    geometry = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry")
    properties = F.struct(*[c for c in areas.columns if c != boundary]).alias("properties")
    write(areas.select(F.lit("Feature").alias("type"), properties, geometry), path, compression)
