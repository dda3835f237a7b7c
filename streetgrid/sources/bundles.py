"""Prediction bundles: a folder or file for each run, named by the run, with columns ``logit__<target>`` and ``y__<target>``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run's name: backbone, evaluation, cities, tier, ablation and seed. Fixed values.
NAME = r"^([a-z_0-9+]+?)__(cross_city|in_city)__([a-z+]+)_to_([a-z]+)__tier(\d+)__([a-z_]+)__seed(\d+)$"
PARTS = {"backbone": "string", "evaluation": "string", "src": "string", "dst": "string", "tier": "int", "ablation": "string", "seed": "int"}
#: Adapters trained without one city count as one backbone; fixed values.
FAMILIES = ("siglip_lora_loco_v2", "siglip_lora_loco")


def name_parts(name: Column) -> dict[str, Column]:
    """The parts of a run's name and ``family``, the backbone without the city that its adapter leaves out; null where it is no run."""
    parts = {n: F.when(name.rlike(NAME), F.regexp_extract(name, NAME, i)).cast(kind) for i, (n, kind) in enumerate(PARTS.items(), 1)}
    family = parts["backbone"]
    for f in reversed(FAMILIES):
        family = F.when(parts["backbone"].startswith(f + "_"), f).otherwise(family)
    return parts | {"family": family}


def write_bundles(rows: DataFrame, path: str) -> None:
    """Rows with ``run_id`` as one folder for each run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


#: The run in a path: the name of a file, or of the folder it lies in.
IN_PATH = r"([^/=]+__seed\d+)(?:\.parquet$|/[^/]*$)"
#: Runs whose names are broadcast; more are joined.
FEW_RUNS = 1 << 16


def read_bundles(spark: SparkSession, path: str, few: int = FEW_RUNS) -> DataFrame:
    """A row for each run, target and point that has a logit: the name's parts, target, point_id, y, logit.

    Runs may have different targets. What lies under a name that is no run's is left out. Names are taken apart once a run, not once a row.
    """
    files = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    targets = [c.removeprefix("logit__") for c in files.columns if c.startswith("logit__")]
    if not targets:
        raise ValueError(f"no logits under {path}")
    # The list of files, which the driver has from planning the scan.
    names = sorted({m.group(1) for f in files.inputFiles() if (m := re.search(IN_PATH, f))})
    parts = name_parts(F.col("_run"))
    runs = spark.createDataFrame([(n,) for n in names], "_run string").filter(F.col("_run").rlike(NAME)).select("_run", *(c.alias(n) for n, c in parts.items()))
    known = lambda c: F.when(~F.isnan(c), F.col(c).cast("double")) if c in files.columns else F.lit(None).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), known(f"y__{t}").alias("y"), known(f"logit__{t}").alias("logit")) for t in targets)))
    rows = files.select(F.regexp_extract("_metadata.file_path", IN_PATH, 1).alias("_run"), "point_id", each.alias("_t")).select("_run", "point_id", "_t.*").filter("logit IS NOT NULL")
    return rows.join(F.broadcast(runs) if len(names) <= few else runs, "_run").select(*parts, "point_id", "target", "y", "logit")
