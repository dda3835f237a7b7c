"""Parsing of keys, times, run ids and caption answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed values of caption fields; fixed values.
SINGLE = {
    "sidewalk": ("none", "one_side", "both_sides", "unknown"),
    "crosswalk": ("present", "absent", "unknown"),
    "bike_lane": ("present", "absent", "unknown"),
    "traffic_volume": ("low", "med", "high", "unknown"),
    "tree_canopy": ("none", "sparse", "moderate", "dense", "unknown"),
    "transit_stop": ("present", "absent", "unknown"),
    "lighting": ("good", "poor", "unknown"),
    "maintenance": ("good", "fair", "poor", "unknown"),
}
MULTI = {
    "land_use": ("residential", "commercial", "industrial", "mixed", "unknown"),
    "barriers": ("highway", "rail", "river", "fence", "none", "unknown"),
}
#: Fields of the canonical answer in its order; ``traffic`` is what it calls ``traffic_volume``. Fixed values.
CANONICAL = ("sidewalk", "crosswalk", "bike_lane", "traffic", "tree_canopy", "land_use", "transit_stop", "lighting", "maintenance", "barriers")
#: Ordinal codes; unknown has none.
ORDINAL = {
    "sidewalk": {"none": 0, "one_side": 1, "both_sides": 2},
    "crosswalk": {"absent": 0, "present": 1},
    "traffic_volume": {"low": 0, "med": 1, "high": 2},
    "tree_canopy": {"none": 0, "sparse": 1, "moderate": 2, "dense": 3},
    "transit_stop": {"absent": 0, "present": 1},
}
#: Prefixes of compound point ids; fixed values.
CITY_OF_PREFIX = {"MSP": "msp", "SEA": "seattle", "DC": "dc", "PGH": "pittsburgh"}


def compound_key(city: Column, point_id: Column) -> Column:
    """``MSP_0`` from city and id."""
    prefix = F.create_map(*(F.lit(x) for p, c in CITY_OF_PREFIX.items() for x in (c, p)))
    return F.concat(prefix[city], F.lit("_"), point_id.cast("string"))


def split_compound(key: Column) -> tuple[Column, Column]:
    """City and id; null where the key has another form."""
    city = F.create_map(*(F.lit(x) for p, c in CITY_OF_PREFIX.items() for x in (p, c)))
    return city[F.split_part(key, F.lit("_"), F.lit(1))], F.try_to_number(F.split_part(key, F.lit("_"), F.lit(2)), F.lit("999999999")).cast("long")


def clean_geoid(value: Column) -> tuple[Column, Column]:
    """Block-group id without a decimal tail, filled to 11 digits where shorter, and its tract."""
    geoid = F.regexp_replace(F.trim(value), r"\.0$", "")
    geoid = F.when(F.length(geoid) < 11, F.lpad(geoid, 11, "0")).otherwise(geoid)
    return geoid, F.substring(geoid, 1, 11)


def gtfs_minutes(time: Column) -> Column:
    """Minutes after midnight, hours may be over 23; -1 where the text is no time."""
    parts = F.split(F.trim(time), ":")
    minutes = F.expr("0") + F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    return F.coalesce(F.when(F.size(parts) >= 2, minutes), F.lit(-1))


def parse_answer(answer: Column) -> Column:
    """``k=v, k=v|w`` as a map; ``traffic`` is the old name of ``traffic_volume``."""
    pairs = F.filter(F.split(answer, ","), lambda p: F.instr(p, "=") > 0)
    entry = lambda p: F.struct(F.regexp_replace(F.trim(F.split_part(p, F.lit("="), F.lit(1))), "^traffic$", "traffic_volume"), F.trim(F.split_part(p, F.lit("="), F.lit(2))))
    entries = F.transform(pairs, entry)
    return F.map_from_entries(F.filter(entries, lambda e: e["col1"] != ""))


def pick_single(field: str, value: Column) -> Column:
    """An allowed value, else ``unknown``."""
    value = F.lower(F.trim(value))
    return F.when(value.isin(*SINGLE[field]), value).otherwise("unknown")


def pick_multi(field: str, value: Column) -> Column:
    """The allowed values of ``a|b``, once each, in fixed order; ``none`` rules out other barriers; empty: ``unknown``."""
    given = F.transform(F.split(value, r"\|"), lambda x: F.lower(F.trim(x)))
    found = F.filter(F.array(*map(F.lit, MULTI[field])), lambda a: F.array_contains(given, a))
    if field == "barriers":
        found = F.when(F.array_contains(found, "none"), F.array(F.lit("none"))).otherwise(found)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def ordinal(field: str, value: Column) -> Column:
    """Code of a value; null for unknown ones."""
    return F.create_map(*(F.lit(x) for pair in ORDINAL[field].items() for x in pair))[value]


def first_json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


RUN_ID = r"^(.+)__(\w+?)_to_(\w+?)__(\w+)__seed(\d+)$"


def parse_run_id(run_id: Column) -> dict[str, Column]:
    """backbone, train_city, test_city, ablation, seed of ``backbone__a_to_b__ablation__seed1``; null where it does not fit.

    Adapters that leave out a city are one backbone, whichever city it is.
    """
    part = lambda i: F.when(run_id.rlike(RUN_ID), F.regexp_extract(run_id, RUN_ID, i))
    backbone = F.regexp_replace(part(1), r"_loco_(msp|seattle|dc|pittsburgh)$", "_loco")
    return {"backbone": backbone, "train_city": part(2), "test_city": part(3), "ablation": part(4), "seed": part(5).cast("int")}


def feature_key(*candidates: Column) -> Column:
    """The first id that is there."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in candidates))
