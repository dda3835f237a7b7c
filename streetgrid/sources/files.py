"""Readers and writers for the formats of benchmark data."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Names that one column goes by in different exports; fixed values.
SYNONYMS = {"label_type": ("label_type", "labelType", "attribute_type"), "lat": ("lat", "latitude", "y"), "lon": ("lon", "lng", "longitude", "x")}


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with typed columns (ids stay text), trimmed headers, and only the wanted columns read."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str, ordinal: str | None = None) -> DataFrame:
    """JSON lines; blank and broken ones, and those that are no object, are left out.

    ``ordinal``: a column with the line's number in its file, from 0, that counts those lines too. Blocks of a file are read apart,
    so lines are counted by block first, and no task reads a whole file.
    """
    full = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    lines = spark.read.text(path)
    if ordinal:
        block = ["_file", "_start"]
        lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
        sizes = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        # A row for each block of a file.
        earlier = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        lines = lines.join(sizes.withColumn("_before", earlier).drop("_n"), block).select("value", (F.col("_before") + F.col("_id") - F.col("_first")).alias("_ordinal"))
    parsed = lines.withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    kept = parsed.filter(F.ltrim("value").startswith("{") & F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull())
    return kept.select(*(F.col("_r")[f.name].alias(f.name) for f in full.fields[:-1]), *([F.col("_ordinal").alias(ordinal)] if ordinal else []))


#: Points of one GeoJSON collection, about.
FEATURES = 20_000


def write_geojson(points: DataFrame, path: str) -> None:
    """Points (city, point_id, lat, lon) as collections of about FEATURES points of one city at most, a file each."""
    feature = F.struct(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("point_id").alias("properties"))
    sizes = points.groupBy(F.col("city").alias("_city")).agg(F.ceil(F.count(F.lit(1)) / FEATURES).alias("_files"))
    parted = points.join(F.broadcast(sizes), F.col("city").eqNullSafe(F.col("_city")))
    parted = parted.select("city", F.pmod(F.xxhash64("point_id", "lat", "lon"), F.col("_files")).alias("part"), feature.alias("_feature"))
    collections = parted.groupBy("city", "part").agg(F.to_json(F.struct(F.collect_list("_feature").alias("features"))).alias("value"))
    collections.write.partitionBy("city", "part").text(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a collection as rows: lon, lat and the named properties."""
    schema = f"features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return rows.select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def unify(df: DataFrame, synonyms: dict[str, tuple[str, ...]] = SYNONYMS) -> DataFrame:
    """Columns under their usual names: of several synonyms, in any case, the first that holds a value."""
    lower = {c.lower(): c for c in df.columns}
    used, out = set(), []
    for name, others in synonyms.items():
        found = [lower[o.lower()] for o in others if o.lower() in lower]
        if found:
            out.append(F.coalesce(*(F.col(c) for c in found)).alias(name))
            used |= set(found)
    return df.select(*out, *(c for c in df.columns if c not in used))


def element_points(elements: DataFrame) -> DataFrame:
    """Nodes and ways with a place: their own coordinates, else their centre's."""
    placed = elements.withColumns({"lat": F.coalesce("lat", "center.lat"), "lon": F.coalesce("lon", "center.lon")})
    return placed.filter("lat IS NOT NULL AND lon IS NOT NULL").drop("center")


def marked_crossing(tags: Column) -> Column:
    """Tags of a marked crossing; fixed values."""
    kinds = ("marked", "zebra", "tiger", "ladder", "lines", "dashes", "dots")
    markings = tags["crossing:markings"]
    return F.coalesce(tags["crossing"].isin(*kinds), F.lit(False)) | F.coalesce(tags["crossing_ref"] == "zebra", F.lit(False)) | F.coalesce((markings != "") & (markings != "no"), F.lit(False))


def tag_holds(value: Column, wanted: str) -> Column:
    """A tag that is one value or a list of values."""
    return F.array_contains(F.transform(F.split(F.regexp_replace(value, r"[\[\]'\"]", ""), r"[,;]"), F.trim), wanted)


def write_by_city(df: DataFrame, path: str) -> None:
    """Replace the cities that are in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def key_from_name(column: str = "file") -> list[Column]:
    """Point and heading of ``{point}_{heading}.jpg`` names."""
    return [F.regexp_extract(column, r"(\d+)_(\d+)\.jpg$", i).cast("long").alias(n) for i, n in ((1, "point_id"), (2, "heading"))]


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of image files by their names; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(F.col("path").alias("file"))
    return files.select("file", *key_from_name())


def read_gtfs(spark: SparkSession, folder: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """All named tables (name -> schema); one that is not there fails at once."""
    return {name: read_csv(spark, f"{folder}/{name}.txt", schema) for name, schema in tables.items()}


def decode_points(df: DataFrame, wkb: str = "wkb") -> DataFrame:
    """x and y of point WKB of either byte order, in Arrow batches; null where the bytes are no point."""
    @pandas_udf("struct<x: double, y: double>")
    def decode(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None or len(b) < 21 else struct.unpack_from("<dd" if b[0] else ">dd", b, 5) for b in raw], columns=["x", "y"])

    return df.withColumn("_p", decode(wkb)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
