"""Caption tables, and how far captions and image masks agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Pairs of a caption's and a mask's code that make the score; that of stops is only reported, as a stop may be near but not in view.
PAIRS, REPORTED = ("sidewalk", "crosswalk", "tree_canopy"), "transit_stop"


def validated(captions: DataFrame) -> DataFrame:
    """Caption rows with every field an allowed value, and the canonical answer."""
    found = text.parse_answer(F.col("answer"))
    fields = {f: text.pick_single(f, found[f]) for f in text.SINGLE} | {f: F.array_join(text.pick_multi(f, found[f]), "|") for f in text.MULTI}
    out = captions.withColumns(fields)
    said = (F.concat(F.lit(f + "="), F.col("traffic_volume" if f == "traffic" else f)) for f in text.CANONICAL)
    return out.withColumn("canonical", F.concat_ws(", ", *said))


def features(captions: DataFrame) -> DataFrame:
    """Validated captions with ordinal codes (-1 unknown), land uses as 0/1, and the known part of the fields."""
    fields = list(text.SINGLE)
    codes = {f"{f}_code": F.coalesce(text.ordinal(f, F.col(f)), F.lit(-1)) for f in text.ORDINAL}
    uses = {f"use_{u}": F.array_contains(F.split("land_use", r"\|"), u).cast("int") for u in text.MULTI["land_use"]}
    unknown = sum(((F.col(f) == "unknown").cast("int") for f in fields), F.lit(0))
    return captions.withColumns(codes | uses).withColumn("unknown_count", unknown).withColumn("known_fraction", 1 - F.col("unknown_count") / len(fields))


#: Categories that a field may have before its columns are too many for a table.
MOST_CATEGORIES = 1000


def categories(captions: DataFrame, most: int = MOST_CATEGORIES) -> dict[str, list[str]]:
    """Of each field the values that occur in the table, sorted; several at once where a field may have several (``a|b``)."""
    value = lambda f: F.split(F.col(f), r"\|") if f in text.MULTI else F.array(F.lower(F.coalesce(F.col(f), F.lit("unknown"))))
    fields = [*text.SINGLE, *text.MULTI]
    each = captions.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("v")) for f in fields))).alias("s")).select("s.field", F.explode("s.v").alias("value"))
    found = each.filter("value <> ''").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.slice(F.collect_set("value"), 1, most)).alias("values")).collect()
    if large := [r["field"] for r in found if r["n"] > most]:
        raise ValueError(f"more than {most} values in {large}")
    return {f: r["values"] for f in fields for r in found if r["field"] == f}


def one_hot(captions: DataFrame, found: dict[str, list[str]] | None = None) -> DataFrame:
    """Validated captions with ``cap_<field>__<value>`` (0 or 1) for each value that occurs, ordinals with a flag, and what is unknown.

    ``found``: the values of another table, so that a table to be scored gets the columns of the one that a model was fitted on.
    """
    found = categories(captions) if found is None else found
    said = {f: F.lower(F.coalesce(F.col(f), F.lit("unknown"))) for f in text.SINGLE}
    many = {f: F.split(F.coalesce(F.col(f), F.lit("unknown")), r"\|") for f in text.MULTI}
    cols = {f"cap_{f}__{v}": (said[f] == v if f in said else F.array_contains(many[f], v)).cast("int") for f, values in found.items() for v in values}
    for f in text.ORDINAL:
        code = F.coalesce(text.ordinal(f, said[f]), F.lit(-1))
        cols |= {f"cap_{f}_ord": code, f"cap_{f}_known": (code >= 0).cast("int")}
    gaps = [*(c == "unknown" for c in said.values()), *(F.array_contains(c, "unknown") for c in many.values())]
    unknown = sum((g.cast("int") for g in gaps), F.lit(0))
    return captions.withColumns(cols | {"cap_unknown_count": unknown, "cap_known_fraction": (len(gaps) - unknown) / len(gaps)})


def binned(value: Column, low: float, high: float) -> Column:
    """0 below ``low``, 2 from ``high`` on, else 1; null stays null."""
    return F.when(value.isNull(), None).when(value < low, 0).when(value >= high, 2).otherwise(1)


def mask_codes(points: DataFrame) -> DataFrame:
    """Codes of points' features: fixed borders for the largest walk and crossing of a point, the table's own quantiles for
    its mean of trees, and whether a stop is within 400 m; null features stay null."""
    cuts = points.agg(F.percentile("vegetation_mean", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("cuts"))
    v = F.col("vegetation_mean")
    trees = F.when(v.isNull(), None).when(v <= F.col("cuts")[0], 0).when(v <= F.col("cuts")[1], 1).when(v <= F.col("cuts")[2], 2).otherwise(3)
    coded = points.crossJoin(F.broadcast(cuts))  # one row
    codes = {"b_sidewalk": binned(F.col("sidewalk_max"), 0.02, 0.095), "b_crosswalk": (F.col("crosswalk_max") > 0.02).cast("int"), "b_tree_canopy": trees, "b_transit_stop": (F.col("stops_400m") > 0).cast("int")}
    return coded.withColumns(codes).drop("cuts")


def score(captions: DataFrame, masks: DataFrame, key: list[str]) -> DataFrame:
    """Mean of the pairs that can be compared: walks and trees agree within one step, crossings when equal; with a tier."""
    both = captions.withColumns({f"a_{f}": text.ordinal(f, F.col(f)) for f in (*PAIRS, REPORTED)}).join(masks, key)
    flag = lambda f, most: (F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) <= most).cast("int")
    both = both.withColumns({"ok_sidewalk": flag("sidewalk", 1), "ok_crosswalk": flag("crosswalk", 0), "ok_tree_canopy": flag("tree_canopy", 1), "ok_transit_stop": flag("transit_stop", 0)})
    flags = F.filter(F.array(*(F.col(f"ok_{f}") for f in PAIRS)), lambda x: x.isNotNull())
    mean = F.when(F.size(flags) > 0, F.round(F.aggregate(flags, F.lit(0), lambda a, x: a + x) / F.size(flags), 4))
    tier = F.when(F.col("score") <= 0.4999, "disagreement").when(F.col("score") <= 0.7499, "partial").when(F.col("score").isNotNull(), "high_confidence")
    return both.withColumn("score", mean).withColumn("tier", tier)
