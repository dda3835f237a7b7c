"""Queries on vector blocks with ids, prediction bundles, caption columns and lines with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import agreement, alignment, metrics, runlog
from ..sources import bundles, files
from ..sources.shared import cut, new_path
from .evaluation import _auc_sql, _ranked
from .fixtures import load
from .registry import query
from .tabular import _CAP, _code

KEY = ["city", "point_id"]
_CITY = "CASE {id} % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END"

_VECTORS = f"SELECT {_CITY.format(id='vec_id')} AS city, CAST(floor(vec_id / 4e0) AS BIGINT) AS point_id, vec_id, e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8) AS x1 FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(
    "vector_blocks",
    "city n_points:i n_street:i n_naip:i n_shared:i street_x1:f naip_x1:f",
    f"""WITH s AS (SELECT * FROM ({_VECTORS}) WHERE vec_id % 3 <> 0), n AS (SELECT * FROM ({_VECTORS}) WHERE vec_id % 5 <> 0),
    l AS (SELECT DISTINCT city, point_id FROM fx_mask_stats WHERE mask_coverage > 0)
    SELECT p.city, count(*) AS n_points, count(s.x1) AS n_street, count(n.x1) AS n_naip, count(CASE WHEN s.x1 IS NOT NULL AND n.x1 IS NOT NULL AND l.city IS NOT NULL THEN 1 END) AS n_shared,
    avg(CASE WHEN n.x1 IS NOT NULL AND l.city IS NOT NULL THEN s.x1 END) AS street_x1, avg(CASE WHEN s.x1 IS NOT NULL AND l.city IS NOT NULL THEN n.x1 END) AS naip_x1
    FROM fx_points p LEFT JOIN s ON s.city = p.city AND s.point_id = p.point_id LEFT JOIN n ON n.city = p.city AND n.point_id = p.point_id LEFT JOIN l ON l.city = p.city AND l.point_id = p.point_id GROUP BY p.city""",
)
def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two sources, stored by row with their ids beside them, aligned to the points; and points that both sources and the labels have."""
    path, block = new_path(spark, "vectors"), ["source", "city"]
    e = load(spark, sf_dir, "embeddings").select(F.expr(_CITY.format(id="vec_id")).alias("city"), F.floor(F.col("vec_id") / 4).alias("point_id"), F.col("vec_id").alias("row"), F.col("embedding").alias("vector"))
    both = e.filter("row % 3 <> 0").withColumn("source", F.lit("street")).unionByName(e.filter("row % 5 <> 0").withColumn("source", F.lit("naip")))
    both.select(*block, "row", "vector").write.partitionBy(*block).parquet(f"{path}/vectors")
    both.select(*block, "row", "point_id").write.partitionBy(*block).json(f"{path}/ids")
    sidecar = spark.read.schema("row long, point_id long, source string, city string").json(f"{path}/ids")
    stored = alignment.with_ids(spark.read.parquet(f"{path}/vectors"), sidecar, block)
    points = load(spark, sf_dir, "fx_points").select(*KEY)
    labels = load(spark, sf_dir, "fx_mask_stats").filter("mask_coverage > 0")
    sides = {name: stored.filter(F.col("source") == name) for name in ("street", "naip")}
    aligned = points
    for name, side in sides.items():
        aligned = alignment.align(aligned, side).withColumnsRenamed({"vector": name, "present": f"has_{name}"})
    shared = alignment.in_all(points, *sides.values(), labels).withColumn("shared", F.lit(1))
    rows = aligned.join(shared, KEY, "left")
    mean = lambda c: F.avg(F.when(F.col("shared") == 1, F.col(c)[0]))
    return rows.groupBy("city").agg(F.count(F.lit(1)).alias("n_points"), F.sum("has_street").alias("n_street"), F.sum("has_naip").alias("n_naip"), F.count("shared").alias("n_shared"), mean("street").alias("street_x1"), mean("naip").alias("naip_x1"))


CELL = ["src", "dst", "tier", "ablation"]
#: Targets by the metric that suits them.
BINARY, REGRESSION = "ramp", "price"
_RUNS = """SELECT CASE WHEN backbone = 'siglip' AND seed = 43 THEN 'siglip_lora_loco' ELSE backbone END AS family, seed, CASE WHEN city = 'msp' THEN 'dc' ELSE 'msp' END AS src, city AS dst, point_id, y_bin, y_reg, score
    FROM fx_predictions WHERE NOT (backbone = 'clip' AND seed = 41)"""


def _bundles(spark, sf_dir):
    """Predictions as bundles and back: one backbone has no first seed and one target only, another's last seed is an adapter's; one folder is no run."""
    path = new_path(spark, "bundles")
    p = load(spark, sf_dir, "fx_predictions").filter("NOT (backbone = 'clip' AND seed = 41)")
    backbone = F.when((F.col("backbone") == "siglip") & (F.col("seed") == 43), F.concat(F.lit("siglip_lora_loco_"), "city")).otherwise(F.col("backbone"))
    src = F.when(F.col("city") == "msp", "dc").otherwise("msp")
    p = p.withColumn("run_id", F.concat(backbone, F.lit("__cross_city__"), src, F.lit("_to_"), "city", F.lit("__tier1__full__seed"), F.col("seed").cast("string")))
    ramp = [F.col("y_bin").cast("double").alias("y__ramp"), F.col("score").cast("double").alias("logit__ramp")]
    price = [F.col("y_reg").cast("double").alias("y__price"), (F.col("score").cast("double") * 2).alias("logit__price")]
    bundles.write_bundles(p.filter("backbone = 'siglip'").select("run_id", "point_id", *ramp, *price), path)
    bundles.write_bundles(p.filter("backbone = 'clip'").select("run_id", "point_id", *ramp), path)
    bundles.write_bundles(p.filter("seed = 42").select(F.lit("notes").alias("run_id"), "point_id", *ramp), path)
    # Written once, as metrics, seeds and pairs all read it.
    return cut(bundles.read_bundles(spark, path))


_RHO = "SELECT {by}, corr(ra, rb) AS rho FROM ({source}) GROUP BY {by}"
_BY = "family, seed, src, dst"


@query(
    "bundle_summary",
    "target n_runs:i auroc_mean:f auroc_std:f ap_mean:f rho_mean:f rho_std:f",
    f"""WITH r AS ({_RUNS}), a AS ({_auc_sql("SELECT * FROM r WHERE y_bin IS NOT NULL", _BY)}),
    ap AS (SELECT {_BY}, sum(p * pr) / sum(p) AS ap FROM (SELECT *, sum(p) OVER w / sum(m) OVER w AS pr FROM (SELECT {_BY}, score, sum(CASE WHEN y_bin = 1 THEN 1e0 ELSE 0e0 END) AS p, count(*) AS m FROM r WHERE y_bin IS NOT NULL GROUP BY {_BY}, score) WINDOW w AS (PARTITION BY {_BY} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {_BY}),
    h AS ({_RHO.format(by=_BY, source=_ranked("SELECT * FROM r WHERE family <> 'clip'", _BY, "y_reg", "score"))})
    SELECT 'ramp' AS target, count(*) AS n_runs, avg(auroc) AS auroc_mean, stddev_samp(auroc) AS auroc_std, (SELECT avg(ap) FROM ap) AS ap_mean, NULL AS rho_mean, NULL AS rho_std FROM a
    UNION ALL SELECT 'price', count(*), NULL, NULL, NULL, avg(rho), stddev_samp(rho) FROM h""",
)
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by target: area and precision of those with two classes, rank correlation of others, each over all runs that have it."""
    rows, by = _bundles(spark, sf_dir), ["family", "seed", *CELL, "target"]
    two, many = rows.filter(F.col("target") == BINARY), rows.filter(F.col("target") == REGRESSION)
    runs = rows.select(*by).distinct()
    for found in (metrics.auroc(two, by, "y", "logit"), metrics.average_precision(two, by, "y", "logit"), metrics.spearman(many, by, "y", "logit")):
        runs = runs.join(found, by, "left")
    return runs.groupBy("target").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_std"), F.avg("ap").alias("ap_mean"), F.avg("rho").alias("rho_mean"), F.stddev_samp("rho").alias("rho_std"))


#: Backbones that are held against each other.
PAIRS = (("siglip", "clip"), ("siglip_lora_loco", "siglip"))
_PAIRED = " UNION ALL ".join(
    f"SELECT '{a}' AS one, '{b}' AS other, x.src, x.dst, x.seed AS seed_a, y.seed AS seed_b, x.point_id, x.y_bin, x.y_reg, x.score AS score_a, y.score AS score_b FROM f x JOIN f y ON x.src = y.src AND x.dst = y.dst AND x.point_id = y.point_id WHERE x.family = '{a}' AND y.family = '{b}'" for a, b in PAIRS
)
_PB = "one, other, src, dst"


@query(
    "bundle_pairs",
    "one other src dst target seed_a:i seed_b:i n:i metric_a:f metric_b:f gap:f",
    f"""WITH r AS ({_RUNS}), f AS (SELECT * FROM (SELECT *, min(seed) OVER (PARTITION BY family, src, dst) AS s0 FROM r) WHERE seed = s0), p AS ({_PAIRED}),
    n AS (SELECT {_PB}, min(seed_a) AS seed_a, min(seed_b) AS seed_b, count(*) AS n FROM p GROUP BY {_PB}),
    ta AS ({_auc_sql("SELECT * FROM p WHERE y_bin IS NOT NULL", _PB, s="score_a")}), tb AS ({_auc_sql("SELECT * FROM p WHERE y_bin IS NOT NULL", _PB, s="score_b")}),
    q AS (SELECT * FROM p WHERE other = 'siglip'), ha AS ({_RHO.format(by=_PB, source=_ranked("SELECT * FROM q", _PB, "y_reg", "score_a"))}), hb AS ({_RHO.format(by=_PB, source=_ranked("SELECT * FROM q", _PB, "y_reg", "score_b"))})
    SELECT n.*, 'ramp' AS target, ta.auroc AS metric_a, tb.auroc AS metric_b, ta.auroc - tb.auroc AS gap FROM n JOIN ta USING (one, other, src, dst) JOIN tb USING (one, other, src, dst)
    UNION ALL SELECT n.*, 'price', ha.rho, hb.rho, ha.rho - hb.rho FROM n JOIN ha USING (one, other, src, dst) JOIN hb USING (one, other, src, dst)""",
)
def bundle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two backbones on the points that both scored, first seeds of each, and how far apart their metrics are."""
    rows, by = _bundles(spark, sf_dir), ["one", "other", *CELL, "target"]
    both = None
    for a, b in PAIRS:
        one = runlog.paired(rows, a, b, CELL, "family").withColumns({"one": F.lit(a), "other": F.lit(b)})
        both = one if both is None else both.unionByName(one)
    both = cut(both)
    found = both.groupBy(*by).agg(F.min("seed_a").alias("seed_a"), F.min("seed_b").alias("seed_b"), F.count(F.lit(1)).alias("n"))
    # Both sides go through one metric.
    long = both.select(*by, "y", F.explode(F.create_map(F.lit("a"), "score_a", F.lit("b"), "score_b")).alias("side", "score"))
    two, many = long.filter(F.col("target") == BINARY), long.filter(F.col("target") == REGRESSION)
    each = metrics.auroc(two, [*by, "side"], "y", "score", name="m").unionByName(metrics.spearman(many, [*by, "side"], "y", "score", name="m"))
    found = found.join(each.groupBy(*by).agg(*(F.max(F.when(F.col("side") == side, F.col("m"))).alias(f"metric_{side}") for side in "ab")), by)
    return found.select("one", "other", "src", "dst", "target", "seed_a", "seed_b", "n", "metric_a", "metric_b", (F.col("metric_a") - F.col("metric_b")).alias("gap"))


_CAP_FIELDS = ("sidewalk", "crosswalk", "traffic_volume", "tree_canopy", "transit_stop")
_ONE_HOT = " UNION ALL ".join(
    [f"SELECT concat('cap_{f}__', {f}) AS feature, count(*) AS total FROM c GROUP BY {f}" for f in _CAP_FIELDS]
    + [f"SELECT 'cap_{f}__unknown', count(*) FROM c" for f in ("bike_lane", "lighting", "maintenance", "barriers")]
    + ["SELECT concat('cap_land_use__', v), count(*) FROM (SELECT unnest(string_split(land_use, '|')) AS v FROM c) GROUP BY v"]
    + [f"SELECT 'cap_{f}_ord', sum({_code(f)}) FROM c UNION ALL SELECT 'cap_{f}_known', count(CASE WHEN {f} <> 'unknown' THEN 1 END) FROM c" for f in text.ORDINAL]
    + [f"SELECT '{n}', {e} FROM (SELECT 4 + {' + '.join(f'CASE WHEN {f} = {chr(39)}unknown{chr(39)} THEN 1 ELSE 0 END' for f in (*_CAP_FIELDS, 'land_use'))} AS u FROM c)" for n, e in (("cap_unknown_count", "sum(u)"), ("cap_known_fraction", "sum(1 - u / 10e0)"))]
)


@query("caption_one_hot", "feature total:f", f"WITH c AS ({_CAP}) SELECT * FROM ({_ONE_HOT})")
def caption_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every column that the values in the captions give."""
    rows = agreement.one_hot(agreement.validated(load(spark, sf_dir, "fx_captions")))
    columns = [c for c in rows.columns if c.startswith("cap_")]
    return rows.agg(*(F.sum(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "total")


STEP = 0.02
_EDGES = "SELECT city, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM fx_points GROUP BY city"


@query(
    "tile_boxes",
    "city west:f south:f east:f north:f n_points:i",
    f"""WITH b AS ({_EDGES}), t AS (SELECT city, w + j * {STEP} AS west, s + i * {STEP} AS south, least(w + j * {STEP} + {STEP}, e) AS east, least(s + i * {STEP} + {STEP}, n) AS north FROM b, range(0, 100) y(i), range(0, 100) x(j) WHERE i < ceil((n - s) / {STEP}) AND j < ceil((e - w) / {STEP}))
    SELECT t.city, west, south, east, north, count(p.city) AS n_points FROM t LEFT JOIN fx_points p ON p.city = t.city AND p.lon >= west AND p.lon <= east AND p.lat >= south AND p.lat <= north GROUP BY t.city, west, south, east, north""",
)
def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 0.02 degrees that cover each city, as they are asked of a feature service, with the points in each (edges belong to both sides)."""
    p = load(spark, sf_dir, "fx_points")
    edges = p.groupBy("city").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    tiles = edges.select("city", F.explode(geo.tile_boxes(F.col("w"), F.col("s"), F.col("e"), F.col("n"), STEP)).alias("t")).select("city", "t.*")
    # A point lies in at most two columns and two rows of tiles, next to the one its place gives.
    near = lambda c, edge: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col(c) - F.col(edge)) / STEP) + d))
    cells = p.join(edges, "city").select("city", "lat", "lon", F.explode(near("lat", "s")).alias("i"), "w").select("city", "lat", "lon", "i", F.explode(near("lon", "w")).alias("j"))
    numbered = tiles.join(edges.select("city", "w", "s"), "city").withColumns({"i": F.round((F.col("south") - F.col("s")) / STEP).cast("long"), "j": F.round((F.col("west") - F.col("w")) / STEP).cast("long")}).drop("w", "s")
    inside = (F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north"))
    return numbered.join(cells, ["city", "i", "j"], "left").groupBy("city", "west", "south", "east", "north").agg(F.count_if(inside).alias("n_points"))


@query("jsonl_ordinals", "priority n:i total:i off:i", "SELECT o_orderpriority AS priority, count(*) AS n, sum(o_orderkey) AS total, 0 AS off FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 GROUP BY o_orderpriority")
def jsonl_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines, some blank and some broken, read back with their numbers; ``off`` counts numbers that are not the line's place in its file."""
    path = new_path(spark, "lines")
    # A task writes one file; the lower 33 bits number its rows.
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.expr("monotonically_increasing_id() & 8589934591").alias("at"))
    line = F.to_json(F.struct("o_orderkey", "priority", "at"))
    k = F.col("o_orderkey")
    rows.select(F.when(k % 7 == 0, F.concat(F.substring(line, 1, 20), F.lit(" "))).when(k % 11 == 0, " ").otherwise(line).alias("value")).write.text(path)
    found = files.read_jsonl(spark, path, "o_orderkey long, priority string, at long", "ordinal")
    return found.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"), F.count_if(F.col("ordinal") != F.col("at")).alias("off"))
