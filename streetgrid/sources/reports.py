"""Report tables that are published whole: a version is written aside, and then one manifest line makes it the latest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = "version long, location string, format string, schema string, n_rows long"
FORMATS = ("json", "csv", "parquet")


def publish(df: DataFrame, path: str, kind: str = "json") -> int:
    """Write a report as the next version under ``path``; returns its number.

    Readers follow the manifest, which names a version only after all its files are there; a job that fails leaves files
    that nobody reads. Reports are few rows: they are one file.
    """
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    spark = df.sparkSession
    location = f"{path}/versions/{uuid.uuid4().hex}"
    writer = df.coalesce(1).write
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(location)
    version = _latest(spark, path)["version"] + 1 if _published(spark, path) else 1
    n = spark.read.schema(df.schema).format(kind).option("header", True).load(location).count()
    row = (version, location, kind, df.schema.json(), n)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def _published(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema(_MANIFEST).json(f"{path}/manifest").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def _latest(spark: SparkSession, path: str, version: int | None = None):
    rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    rows = rows if version is None else rows.filter(F.col("version") == version)
    found = rows.orderBy(F.desc("version"), F.desc("location")).first()
    if found is None:
        raise ValueError("no such report")
    return found


def read_report(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The latest published version, or a given one."""
    found = _latest(spark, path, version)
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).format(found["format"]).option("header", True).load(found["location"])
