"""GeoJSON feature collections and page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A feature collection as rows: feature_index, properties, geometry_type, parts, x, y.

    One document holds all features, so the file is one task; large layers come one feature per line
    (``read_feature_lines``).
    """
    docs = spark.read.schema(f"type string, features array<{FEATURE}>").option("multiLine", True).json(path)
    kind = F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(
        F.raise_error(F.concat(F.lit("not a FeatureCollection: "), F.coalesce("type", F.lit("no type")))))
    return _geometry(docs.select(F.posexplode(kind).alias("feature_index", "f")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line; splits like any text file."""
    rows = spark.read.schema("type string, properties map<string,string>, geometry struct<type:string,coordinates:string>").json(path)
    return _geometry(rows.where("type = 'Feature'").select(
        F.monotonically_increasing_id().alias("feature_index"), F.struct("type", "properties", "geometry").alias("f")))


def _geometry(df: DataFrame) -> DataFrame:
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    point = F.from_json(text, "array<double>")
    return df.select(
        "feature_index", F.col("f.properties").alias("properties"), kind.alias("geometry_type"),
        F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", multi).alias("parts"),
        F.when(kind == "Point", F.get(point, 0)).alias("x"), F.when(kind == "Point", F.get(point, 1)).alias("y"))


def transform_features(features: DataFrame, fn) -> DataFrame:
    """Apply the caller's column logic to a layer; the caller may add columns and drop features."""
    return features.transform(fn)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One whole text per file, with its path."""
    return spark.read.option("wholetext", True).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
