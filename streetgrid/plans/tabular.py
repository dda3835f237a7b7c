"""Queries on keys, locks, captions, transit, agreement and tables as such."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import geo, text
from ..operators import agreement, near, tables, transit
from .fixtures import load
from .registry import hav, query

KEY = ["city", "point_id"]
_LOCK = "SELECT city, point_id FROM fx_points WHERE point_id % 4 <> 1"


def _lock(spark, sf_dir):
    return load(spark, sf_dir, "fx_points").filter("point_id % 4 <> 1").select(*KEY)


@query(
    "best_heading_image",
    "city point_id heading:i image_id:i dist:f err:f",
    f"""WITH i AS (SELECT event_id AS image_id, user_id % 4 AS c, CASE user_id % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
      CASE user_id % 4 WHEN 0 THEN 44.95e0 WHEN 1 THEN 47.60e0 WHEN 2 THEN 38.90e0 ELSE 40.44e0 END + ((event_id * 5171) % 10007) / 10007e0 * 5e-2 AS lat,
      CASE user_id % 4 WHEN 0 THEN -93.20e0 WHEN 1 THEN -122.33e0 WHEN 2 THEN -77.02e0 ELSE -79.98e0 END + ((event_id * 4447) % 9973) / 9973e0 * 5e-2 AS lon,
      CASE WHEN event_type = 'error' THEN NULL ELSE (event_id * 37) % 360 END AS angle, ts FROM events),
    c AS (SELECT p.city, p.point_id, h.heading, i.image_id, {hav("p", "i")} AS dist, abs(((((i.angle - h.heading + 180) % 360) + 360) % 360) - 180) AS err
      FROM fx_points p JOIN i ON p.city = i.city JOIN (VALUES (0), (90), (180), (270)) h(heading) ON i.angle IS NOT NULL AND i.ts >= TIMESTAMP '2024-01-01 00:00:00')
    SELECT city, point_id, heading, image_id, dist, err FROM (SELECT *, row_number() OVER (PARTITION BY city, point_id, heading ORDER BY dist + 25e-2 * err, image_id) AS r FROM c WHERE dist <= 300 AND err <= 60) WHERE r = 1""",
)
def best_heading_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images at events' places: the best by distance and heading error of each point and heading."""
    c = F.col("user_id") % 4
    by_city = lambda *v: F.when(c == 0, v[0]).when(c == 1, v[1]).when(c == 2, v[2]).otherwise(v[3])
    images = load(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (F.col("ts") >= F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))).select(
        F.col("event_id").alias("image_id"), by_city("msp", "seattle", "dc", "pittsburgh").alias("city"),
        (by_city(44.95, 47.60, 38.90, 40.44) + (F.col("event_id") * 5171 % 10007) / 10007.0 * 5e-2).alias("lat"), (by_city(-93.20, -122.33, -77.02, -79.98) + (F.col("event_id") * 4447 % 9973) / 9973.0 * 5e-2).alias("lon"),
        (F.col("event_id") * 37 % 360).alias("angle"),
    )
    return near.best_views(load(spark, sf_dir, "fx_points"), images, KEY, geo.HEADINGS, 300.0, 60.0, 0.25)


_ACTIVE = """SELECT service_id FROM ((SELECT service_id FROM fx_calendar WHERE tuesday = 1 AND 20240312 BETWEEN start_date AND end_date EXCEPT SELECT service_id FROM fx_calendar_dates WHERE date = 20240312 AND exception_type = 2)
  UNION SELECT service_id FROM fx_calendar_dates WHERE date = 20240312 AND exception_type = 1)"""
_PER_STOP = f"""SELECT t.stop_id, count(DISTINCT t.trip_id) AS n_trips, count(DISTINCT t.trip_id) / 16e0 AS trips_per_hour FROM fx_stop_times t JOIN fx_trips r ON r.trip_id = t.trip_id
  WHERE r.service_id IN ({_ACTIVE}) AND departure_time LIKE '%:%:%' AND CAST(split_part(departure_time, ':', 1) AS INT) * 60 + CAST(split_part(departure_time, ':', 2) AS INT) BETWEEN 360 AND 1319 GROUP BY t.stop_id"""


@query("gtfs_rep_day", "rep_day week_day", "SELECT CAST(max_start + CAST((8 - isodow + 1) % 7 + CASE WHEN (8 - isodow + 1) % 7 = 0 THEN 7 ELSE 0 END AS INT) AS VARCHAR) AS rep_day, 'TU' AS week_day FROM (SELECT m AS max_start, isodow(m) AS isodow FROM (SELECT CAST(strptime(CAST(max(start_date) AS VARCHAR), '%Y%m%d') AS DATE) AS m FROM fx_calendar))")
def gtfs_rep_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = load(spark, sf_dir, "fx_calendar").agg(F.max("start_date").alias("s"))
    return latest.select(transit.representative_tuesday(None, F.col("s")).cast("string").alias("rep_day"), F.lit("TU").alias("week_day"))


def _services(spark, sf_dir):
    return transit.active_services(load(spark, sf_dir, "fx_calendar"), load(spark, sf_dir, "fx_calendar_dates"), 20240312, "tuesday")


@query("gtfs_active_services", "service_id:i n_trips:i", f"SELECT s.service_id, count(t.trip_id) AS n_trips FROM ({_ACTIVE}) s LEFT JOIN fx_trips t ON t.service_id = s.service_id GROUP BY s.service_id")
def gtfs_active_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _services(spark, sf_dir).join(load(spark, sf_dir, "fx_trips"), "service_id", "left").groupBy("service_id").agg(F.count("trip_id").alias("n_trips"))


def _per_stop(spark, sf_dir):
    return transit.trips_per_stop(load(spark, sf_dir, "fx_stop_times"), load(spark, sf_dir, "fx_trips"), _services(spark, sf_dir))


@query("gtfs_trips_per_stop", "stop_id:i n_trips:i trips_per_hour:f", _PER_STOP)
def gtfs_trips_per_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_stop(spark, sf_dir)


@query(
    "transit_access",
    "city point_id n_400:i sum_400:f n_800:i sum_800:f",
    f"""WITH s AS (SELECT f.*, coalesce(q.trips_per_hour, 0) AS t FROM fx_stops f LEFT JOIN ({_PER_STOP}) q ON q.stop_id = f.stop_id WHERE location_type <= 1),
    j AS (SELECT a.city, a.point_id, b.t, {hav("a", "b", "stop_lat", "stop_lon")} AS d FROM fx_points a JOIN s b ON a.city = b.city)
    SELECT p.city, p.point_id, count(CASE WHEN d <= 400 THEN 1 END) AS n_400, coalesce(sum(CASE WHEN d <= 400 THEN t END), 0) AS sum_400, count(d) AS n_800, coalesce(sum(t), 0) AS sum_800
    FROM fx_points p LEFT JOIN j ON p.city = j.city AND p.point_id = j.point_id AND d <= 800 GROUP BY p.city, p.point_id""",
)
def transit_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transit.access(load(spark, sf_dir, "fx_points"), load(spark, sf_dir, "fx_stops"), _per_stop(spark, sf_dir), KEY, {"400": 400.0, "800": 800.0})


@query("lock_semi", "city point_id osmid:i", f"SELECT city, point_id, osmid FROM fx_points WHERE (city, point_id) IN ({_LOCK})")
def lock_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.in_lock(load(spark, sf_dir, "fx_points"), _lock(spark, sf_dir)).select(*KEY, "osmid")


@query("lock_anti", "city point_id", f"SELECT city, point_id FROM ({_LOCK}) l WHERE NOT EXISTS (SELECT 1 FROM fx_captions c WHERE c.city = l.city AND c.point_id = l.point_id)")
def lock_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing(_lock(spark, sf_dir), load(spark, sf_dir, "fx_captions"))


@query("lock_sets", "city kind n:i", f"SELECT city, kind, count(*) AS n FROM (SELECT city, 'both' AS kind FROM ({_LOCK} INTERSECT SELECT city, point_id FROM fx_captions) UNION ALL SELECT city, 'lock_only' FROM ({_LOCK} EXCEPT SELECT city, point_id FROM fx_captions)) GROUP BY city, kind")
def lock_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lock, seen = _lock(spark, sf_dir), load(spark, sf_dir, "fx_captions").select(*KEY)
    both = lock.intersect(seen).withColumn("kind", F.lit("both"))
    return both.unionByName(lock.subtract(seen).withColumn("kind", F.lit("lock_only"))).groupBy("city", "kind").agg(F.count(F.lit(1)).alias("n"))


_SEEN = "SELECT city, point_id, heading FROM fx_mask_stats WHERE mask_coverage > 0"


@query(
    "lock_manifest",
    "city point_id status has_caption:i dropped reasons",
    f"""SELECT *, CASE WHEN reasons = '' THEN 'keep' ELSE 'drop' END AS dropped FROM (SELECT l.city, l.point_id, coalesce(s.status, 'none') AS status, CASE WHEN c.point_id IS NULL THEN 0 ELSE 1 END AS has_caption,
    concat_ws('|', CASE WHEN coalesce(s.status, 'none') <> 'complete' THEN 'street_' || coalesce(s.status, 'none') END, CASE WHEN c.point_id IS NULL THEN 'no_caption' END) AS reasons
    FROM ({_LOCK}) l LEFT JOIN (SELECT city, point_id, CASE count(DISTINCT heading) WHEN 4 THEN 'complete' ELSE 'partial' END AS status FROM ({_SEEN}) GROUP BY city, point_id) s ON s.city = l.city AND s.point_id = l.point_id
    LEFT JOIN (SELECT DISTINCT city, point_id FROM fx_captions) c ON c.city = l.city AND c.point_id = l.point_id)""",
)
def lock_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = tables.street_status(load(spark, sf_dir, "fx_mask_stats").filter("mask_coverage > 0"))
    seen = load(spark, sf_dir, "fx_captions").select(*KEY).distinct().withColumn("has_caption", F.lit(1))
    rows = _lock(spark, sf_dir).join(status, KEY, "left").join(seen, KEY, "left").fillna("none", ["status"]).fillna(0, ["has_caption"])
    reasons = F.array_compact(F.array(F.when(F.col("status") != "complete", F.concat(F.lit("street_"), F.col("status"))), F.when(F.col("has_caption") == 0, "no_caption")))
    return rows.withColumn("reasons", F.array_join(reasons, "|")).withColumn("dropped", F.when(F.col("reasons") == "", "keep").otherwise("drop"))


@query(
    "coverage_audit",
    "city n_lock:i n_masks:i n_captions:i pct_masks:f pct_captions:f",
    f"""SELECT l.city, count(*) AS n_lock, count(m.point_id) AS n_masks, count(c.point_id) AS n_captions, round(100e0 * count(m.point_id) / count(*), 1) AS pct_masks, round(100e0 * count(c.point_id) / count(*), 1) AS pct_captions FROM ({_LOCK}) l
    LEFT JOIN (SELECT DISTINCT city, point_id FROM ({_SEEN}) WHERE heading = 90) m ON m.city = l.city AND m.point_id = l.point_id LEFT JOIN (SELECT DISTINCT city, point_id FROM fx_captions) c ON c.city = l.city AND c.point_id = l.point_id GROUP BY l.city""",
)
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"masks": load(spark, sf_dir, "fx_mask_stats").filter("mask_coverage > 0 AND heading = 90"), "captions": load(spark, sf_dir, "fx_captions")}
    rows = _lock(spark, sf_dir)
    for name, source in sources.items():
        rows = rows.join(source.select(*KEY).distinct().withColumn(name, F.lit(1)), KEY, "left")
    counts = rows.groupBy("city").agg(F.count(F.lit(1)).alias("n_lock"), *(F.count(s).alias(f"n_{s}") for s in sources))
    return counts.withColumns({f"pct_{s}": F.round(100.0 * F.col(f"n_{s}") / F.col("n_lock"), 1) for s in sources})


@query(
    "heading_rollup",
    "city point_id sidewalk_mean:f sidewalk_max:f crosswalk_mean:f crosswalk_max:f vegetation_mean:f width_mean:f n_covered:i coverage_mean:f",
    """SELECT city, point_id, avg(sidewalk_frac) AS sidewalk_mean, max(sidewalk_frac) AS sidewalk_max, avg(crosswalk_frac) AS crosswalk_mean, max(crosswalk_frac) AS crosswalk_max, avg(vegetation_frac) AS vegetation_mean,
    coalesce(avg(CASE WHEN sidewalk_width_px > 0 THEN sidewalk_width_px END), 0) AS width_mean, count(CASE WHEN mask_coverage > 0 THEN 1 END) AS n_covered, avg(mask_coverage) AS coverage_mean FROM fx_mask_stats GROUP BY city, point_id""",
)
def heading_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.heading_rollup(load(spark, sf_dir, "fx_mask_stats"))


@query("aerial_flags", "city point_id naip_sidewalk_frac:f naip_missing:i naip_unclassified:i", "SELECT city, point_id, sidewalk_frac AS naip_sidewalk_frac, CASE WHEN mask_coverage = 0 THEN 1 ELSE 0 END AS naip_missing, CASE WHEN mask_coverage > 0 AND sidewalk_frac + crosswalk_frac + vegetation_frac < 1e-1 THEN 1 ELSE 0 END AS naip_unclassified FROM fx_mask_stats WHERE heading = 0")
def aerial_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_mask_stats").filter("heading = 0")
    total = F.col("sidewalk_frac") + F.col("crosswalk_frac") + F.col("vegetation_frac")
    return rows.select(*KEY, F.col("sidewalk_frac").alias("naip_sidewalk_frac"), (F.col("mask_coverage") == 0).cast("int").alias("naip_missing"), ((F.col("mask_coverage") > 0) & (total < 0.1)).cast("int").alias("naip_unclassified"))


@query("outer_fill", "city point_id street:f naip:f naip_missing:i", "SELECT coalesce(s.city, n.city) AS city, coalesce(s.point_id, n.point_id) AS point_id, coalesce(s.v, 0) AS street, coalesce(n.v, 0) AS naip, CASE WHEN n.v IS NULL THEN 1 ELSE 0 END AS naip_missing FROM (SELECT city, point_id, sidewalk_frac AS v FROM fx_mask_stats WHERE heading = 90 AND point_id % 3 <> 0) s FULL JOIN (SELECT city, point_id, vegetation_frac AS v FROM fx_mask_stats WHERE heading = 0 AND point_id % 5 <> 0) n ON s.city = n.city AND s.point_id = n.point_id")
def outer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "fx_mask_stats")
    street = m.filter("heading = 90 AND point_id % 3 <> 0").select(*KEY, F.col("sidewalk_frac").alias("street"))
    aerial = m.filter("heading = 0 AND point_id % 5 <> 0").select(*KEY, F.col("vegetation_frac").alias("naip"))
    return street.join(aerial, KEY, "full").withColumn("naip_missing", F.col("naip").isNull().cast("int")).fillna(0.0, ["street", "naip"])


_FIELD = "trim(regexp_extract(answer, '(^|, )FIELD=([^,]*)', 2))"


def _sql_field(field: str, name: str | None = None) -> str:
    allowed = ", ".join(f"'{v}'" for v in text.SINGLE[field])
    got = _FIELD.replace("FIELD", name or field)
    return f"CASE WHEN {got} IN ({allowed}) THEN {got} ELSE 'unknown' END AS {field}"


_CAP = "SELECT *, " + ", ".join([_sql_field("sidewalk"), _sql_field("crosswalk"), _sql_field("traffic_volume", "traffic"), _sql_field("tree_canopy"), _sql_field("transit_stop")]) + ", CASE _L WHEN 'residential' THEN 'residential' WHEN 'commercial|residential' THEN 'residential|commercial' ELSE 'unknown' END AS land_use".replace("_L", _FIELD.replace("FIELD", "land_use")) + " FROM fx_captions"


@query("caption_parse", "seq sidewalk traffic_volume land_use n_keys:i", f"SELECT seq, {_FIELD.replace('FIELD', 'sidewalk')} AS sidewalk, {_FIELD.replace('FIELD', 'traffic')} AS traffic_volume, {_FIELD.replace('FIELD', 'land_use')} AS land_use, 6 AS n_keys FROM fx_captions")
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.parse_answer(F.col("answer"))
    return load(spark, sf_dir, "fx_captions").select("seq", *(m[f].alias(f) for f in ("sidewalk", "traffic_volume", "land_use")), F.size(m).alias("n_keys"))


@query("caption_validate", "seq sidewalk crosswalk traffic_volume tree_canopy land_use canonical", f"SELECT *, concat('sidewalk=', sidewalk, ', crosswalk=', crosswalk, ', bike_lane=unknown, traffic=', traffic_volume, ', tree_canopy=', tree_canopy, ', land_use=', land_use, ', transit_stop=', transit_stop, ', lighting=unknown, maintenance=unknown, barriers=unknown') AS canonical FROM ({_CAP})")
def caption_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.validated(load(spark, sf_dir, "fx_captions")).select("seq", "sidewalk", "crosswalk", "traffic_volume", "tree_canopy", "land_use", "canonical")


def _code(field: str) -> str:
    return f"coalesce(CASE {field} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.ORDINAL[field].items()) + " END, -1)"


@query(
    "caption_features",
    "city point_id keep seq sidewalk_code:i traffic_volume_code:i use_residential:i use_commercial:i unknown_count:i known_fraction:f",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY city, point_id ORDER BY seq) AS f, row_number() OVER (PARTITION BY city, point_id ORDER BY seq DESC) AS l FROM ({_CAP})),
    k AS (SELECT *, 'first' AS keep FROM c WHERE f = 1 UNION ALL SELECT *, 'last' FROM c WHERE l = 1)
    SELECT city, point_id, keep, seq, {_code("sidewalk")} AS sidewalk_code, {_code("traffic_volume")} AS traffic_volume_code, CASE WHEN land_use LIKE '%residential%' THEN 1 ELSE 0 END AS use_residential, CASE WHEN land_use LIKE '%commercial%' THEN 1 ELSE 0 END AS use_commercial,
    u AS unknown_count, 1 - u / 8e0 AS known_fraction FROM (SELECT *, 3 + (CASE WHEN transit_stop = 'unknown' THEN 1 ELSE 0 END) + (CASE WHEN sidewalk = 'unknown' THEN 1 ELSE 0 END) + (CASE WHEN crosswalk = 'unknown' THEN 1 ELSE 0 END) + (CASE WHEN traffic_volume = 'unknown' THEN 1 ELSE 0 END) + (CASE WHEN tree_canopy = 'unknown' THEN 1 ELSE 0 END) AS u FROM k)""",
)
def caption_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of repeated captions: the first record and the last."""
    rows = agreement.validated(load(spark, sf_dir, "fx_captions"))
    kept = [tables.keep_one(rows, KEY, [o]).withColumn("keep", F.lit(name)) for name, o in (("first", F.asc("seq")), ("last", F.desc("seq")))]
    out = agreement.features(kept[0].unionByName(kept[1]))
    return out.select(*KEY, "keep", "seq", "sidewalk_code", "traffic_volume_code", "use_residential", "use_commercial", "unknown_count", "known_fraction")


@query("caption_unknown_rate", "field rate:f n:i", " UNION ALL ".join(f"SELECT '{f}' AS field, avg(CASE WHEN {f} = 'unknown' THEN 1e0 ELSE 0e0 END) AS rate, count(*) AS n FROM ({_CAP})" for f in ("sidewalk", "crosswalk", "traffic_volume", "tree_canopy")))
def caption_unknown_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("sidewalk", "crosswalk", "traffic_volume", "tree_canopy")
    long = agreement.validated(load(spark, sf_dir, "fx_captions")).select(*fields).unpivot([], list(fields), "field", "value")
    return long.groupBy("field").agg(F.avg((F.col("value") == "unknown").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("json_tolerant", "event_id:i k:i", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside fences and talk are found; broken ones give null."""
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no object: "), F.rpad(F.col("props"), 4, ""))).otherwise(F.concat(F.lit("```json\nHere: "), F.col("props"), F.lit("\n```")))
    return load(spark, sf_dir, "events").select("event_id", F.from_json(text.first_json_object(raw), "k long")["k"].alias("k"))


@query("token_cost", "city prompt_tokens:i completion_tokens:i cost:f", "SELECT city, sum(length(answer)) AS prompt_tokens, sum(length(answer) % 50) AS completion_tokens, (sum(length(answer)) * 25e-1 + sum(length(answer) % 50) * 1e1) / 1e6 * 5e-1 AS cost FROM fx_captions GROUP BY city")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage totals at a price for a million tokens, half of it in batches."""
    rows = load(spark, sf_dir, "fx_captions").withColumn("usage", F.struct(F.length("answer").alias("p"), (F.length("answer") % 50).alias("c")))
    totals = rows.groupBy("city").agg(F.sum("usage.p").alias("prompt_tokens"), F.sum("usage.c").alias("completion_tokens"))
    return totals.withColumn("cost", (F.col("prompt_tokens") * 2.5 + F.col("completion_tokens") * 10.0) / 1e6 * 0.5)


_ROLL = "SELECT city, point_id, max(sidewalk_frac) AS sw, max(crosswalk_frac) AS cw, avg(vegetation_frac) AS veg FROM fx_mask_stats GROUP BY city, point_id"


def _null_code(field: str) -> str:
    return f"CASE {field} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in text.ORDINAL[field].items()) + " END"


_SCORE = f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, point_id ORDER BY seq DESC) AS l FROM ({_CAP})) WHERE l = 1), m AS ({_ROLL}),
  p AS (SELECT DISTINCT a.city, a.point_id FROM fx_points a JOIN fx_stops b ON a.city = b.city AND b.location_type <= 1 AND {hav("a", "b", "stop_lat", "stop_lon")} <= 400),
  q AS (SELECT quantile_cont(veg, 2e-1) AS q1, quantile_cont(veg, 5e-1) AS q2, quantile_cont(veg, 8e-1) AS q3 FROM m),
  f AS (SELECT c.city, c.point_id, CASE WHEN abs({_null_code("sidewalk")} - CASE WHEN sw < 2e-2 THEN 0 WHEN sw >= 95e-3 THEN 2 ELSE 1 END) <= 1 THEN 1 WHEN {_null_code("sidewalk")} IS NULL THEN NULL ELSE 0 END AS f1,
    CASE WHEN {_null_code("crosswalk")} IS NULL THEN NULL WHEN {_null_code("crosswalk")} = CASE WHEN cw > 2e-2 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS f2,
    CASE WHEN {_null_code("tree_canopy")} IS NULL THEN NULL WHEN abs({_null_code("tree_canopy")} - CASE WHEN veg <= q1 THEN 0 WHEN veg <= q2 THEN 1 WHEN veg <= q3 THEN 2 ELSE 3 END) <= 1 THEN 1 ELSE 0 END AS f3,
    CASE WHEN {_null_code("transit_stop")} IS NULL THEN NULL WHEN {_null_code("transit_stop")} = CASE WHEN p.city IS NOT NULL THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS f4
    FROM c JOIN m ON m.city = c.city AND m.point_id = c.point_id LEFT JOIN p ON p.city = c.city AND p.point_id = c.point_id CROSS JOIN q),
  s AS (SELECT *, round((coalesce(f1, 0) + coalesce(f2, 0) + coalesce(f3, 0)) / CAST(nullif((CASE WHEN f1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN f2 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN f3 IS NULL THEN 0 ELSE 1 END), 0) AS DOUBLE), 4) AS score FROM f),
  t AS (SELECT *, CASE WHEN score <= 4999e-4 THEN 'disagreement' WHEN score <= 7499e-4 THEN 'partial' WHEN score IS NOT NULL THEN 'high_confidence' END AS tier FROM s)"""


def _scored(spark, sf_dir):
    captions = tables.keep_one(agreement.validated(load(spark, sf_dir, "fx_captions")), KEY, [F.desc("seq")])
    stops = load(spark, sf_dir, "fx_stops").filter("location_type <= 1")
    near_stops = near.count_and_sum(load(spark, sf_dir, "fx_points"), stops, KEY, {"400": 400.0}, right_at=("stop_lat", "stop_lon"))
    masks = tables.heading_rollup(load(spark, sf_dir, "fx_mask_stats")).join(near_stops.withColumnRenamed("n_400", "stops_400m"), KEY)
    return agreement.score(captions, agreement.mask_codes(masks), KEY)


@query("agreement_score", "city point_id ok_sidewalk:i ok_crosswalk:i ok_tree_canopy:i ok_transit_stop:i score:f tier", _SCORE + " SELECT city, point_id, f1 AS ok_sidewalk, f2 AS ok_crosswalk, f3 AS ok_tree_canopy, f4 AS ok_transit_stop, score, tier FROM t")
def agreement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(*KEY, *(f"ok_{f}" for f in (*agreement.PAIRS, agreement.REPORTED)), "score", "tier")


@query("agreement_summary", "city n:i mean:f std:f median:f n_high:i rate_sidewalk:f", _SCORE + " SELECT coalesce(city, 'all') AS city, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS std, quantile_cont(score, 5e-1) AS median, count(CASE WHEN tier = 'high_confidence' THEN 1 END) AS n_high, avg(f1) AS rate_sidewalk FROM t GROUP BY GROUPING SETS ((city), ())")
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scored(spark, sf_dir).groupingSets([[F.col("city")], []], F.col("city")).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.percentile("score", 0.5).alias("median"), F.count_if(F.col("tier") == "high_confidence").alias("n_high"), F.avg("ok_sidewalk").alias("rate_sidewalk"))
    return found.fillna("all", ["city"])


@query("compound_keys", "key city_back point_back:i", "SELECT CASE city WHEN 'msp' THEN 'MSP' WHEN 'seattle' THEN 'SEA' WHEN 'dc' THEN 'DC' ELSE 'PGH' END || '_' || CAST(point_id AS VARCHAR) AS key, city AS city_back, point_id AS point_back FROM fx_points")
def compound_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_points").select(text.compound_key(F.col("city"), F.col("point_id")).alias("key"))
    city, point = text.split_compound(F.col("key"))
    return rows.select("key", city.alias("city_back"), point.alias("point_back"))


_RAW_ID = "CASE osmid % 3 WHEN 0 THEN CAST(11001000000 + osmid AS VARCHAR) || '.0' WHEN 1 THEN CAST(1001000000 + osmid AS VARCHAR) ELSE ' ' || CAST(270530000001 + osmid AS VARCHAR) END"


@query("geoid_clean", "osmid geoid tract", f"SELECT osmid, geoid, substr(geoid, 1, 11) AS tract FROM (SELECT osmid, CASE WHEN length(g) < 11 THEN lpad(g, 11, '0') ELSE g END AS geoid FROM (SELECT osmid, regexp_replace(trim({_RAW_ID}), '\\.0$', '') AS g FROM fx_points))")
def geoid_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "fx_points").select("osmid", F.expr(_RAW_ID.replace("VARCHAR", "STRING")).alias("raw"))
    geoid, tract = text.clean_geoid(F.col("raw"))
    return raw.select("osmid", geoid.alias("geoid"), tract.alias("tract"))


_RUN = "concat(backbone, '__', train_city, '_to_', test_city, '__', ablation, '__seed', CAST(run_index % 3 + 40 AS {s}), CASE WHEN run_index % 11 = 0 THEN '-bad' ELSE '' END)"


@query("run_id_parse", "run_index backbone train_city test_city ablation seed:i", "SELECT run_index, CASE WHEN ok THEN regexp_replace(backbone, '_loco_dc$', '_loco') END AS backbone, CASE WHEN ok THEN train_city END AS train_city, CASE WHEN ok THEN test_city END AS test_city, CASE WHEN ok THEN ablation END AS ablation, CASE WHEN ok THEN run_index % 3 + 40 END AS seed FROM (SELECT *, run_index % 11 <> 0 AS ok FROM fx_run_log)")
def run_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load(spark, sf_dir, "fx_run_log").select("run_index", F.expr(_RUN.format(s="STRING")).alias("run_id"))
    return ids.select("run_index", *(c.alias(n) for n, c in text.parse_run_id(F.col("run_id")).items()))


@query("feature_key", "label_id key", "SELECT label_id, CASE label_id % 4 WHEN 0 THEN 'a' || CAST(label_id AS VARCHAR) WHEN 1 THEN CAST(label_id AS VARCHAR) WHEN 2 THEN label_type ELSE city END AS key FROM fx_ext_labels")
def feature_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("label_id") % 4
    rows = load(spark, sf_dir, "fx_ext_labels").withColumns({"attribute": F.when(m == 0, F.concat(F.lit("a"), F.col("label_id").cast("string"))), "own": F.when(m == 1, F.col("label_id")), "kind": F.when(m == 2, F.col("label_type")).otherwise("")})
    return rows.select("label_id", text.feature_key(F.col("attribute"), F.col("own"), F.col("kind"), F.col("city")).alias("key"))


@query("upsert_by_city", "city point_id value:i", "SELECT city, point_id, street_count AS value FROM fx_points WHERE city NOT IN ('dc', 'msp') UNION ALL SELECT city, point_id, street_count + 100 FROM fx_points WHERE city IN ('dc', 'msp') AND point_id % 2 = 0")
def upsert_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "fx_points")
    new = p.filter("city IN ('dc', 'msp') AND point_id % 2 = 0").select(*KEY, (F.col("street_count") + 100).alias("value"))
    return tables.replace_part(p.select(*KEY, F.col("street_count").alias("value")), new)


@query("union_aligned", "city point_id street_count:i naip_frac:f", "SELECT city, point_id, street_count, NULL AS naip_frac FROM fx_points WHERE city <> 'dc' UNION ALL SELECT city, point_id, NULL, sidewalk_frac FROM fx_mask_stats WHERE city = 'dc' AND heading = 0")
def union_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "fx_points").filter("city <> 'dc'").select(*KEY, "street_count")
    new = load(spark, sf_dir, "fx_mask_stats").filter("city = 'dc' AND heading = 0").select(*KEY, "sidewalk_frac")
    return tables.append_aligned(old, new, {"sidewalk_frac": "naip_frac"})


@query("dedup_union", "city point_id seq", "SELECT city, point_id, max(seq) AS seq FROM fx_captions GROUP BY city, point_id")
def dedup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping fetches: the last record of a key stays."""
    c = load(spark, sf_dir, "fx_captions").select(*KEY, "seq")
    return tables.keep_one(c.filter("seq % 3 <> 0").unionByName(c.filter("seq % 2 = 0")).unionByName(c.filter("seq % 6 = 3")), KEY, [F.desc("seq")])


@query("table_fingerprint")
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.fingerprint(load(spark, sf_dir, "orders"))


@query("tract_coverage", "tract n_points:i n_covered:i rate:f income:f", "SELECT city || '_' || CAST(point_id % 7 AS VARCHAR) AS tract, count(*) AS n_points, count(CASE WHEN street_count >= 3 THEN 1 END) AS n_covered, count(CASE WHEN street_count >= 3 THEN 1 END) / CAST(count(*) AS DOUBLE) AS rate, avg(CASE WHEN osmid % 5 <> 0 THEN osmid * 10e0 END) AS income FROM fx_points GROUP BY 1")
def tract_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = F.when(F.col("osmid") % 5 == 0, F.lit(-666666666.0)).otherwise(F.col("osmid") * 10.0)
    rows = load(spark, sf_dir, "fx_points").withColumns({"tract": F.concat_ws("_", "city", (F.col("point_id") % 7).cast("string")), "income": tables.without_sentinel(income)})
    out = rows.groupBy("tract").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("street_count") >= 3).alias("n_covered"), F.avg("income").alias("income"))
    return out.withColumn("rate", F.col("n_covered") / F.col("n_points"))


@query("cell_density", "city cell_x:i cell_y:i n_points:i", "SELECT city, floor(lon * 100) AS cell_x, floor(lat * 100) AS cell_y, count(*) AS n_points FROM fx_points GROUP BY 1, 2, 3")
def cell_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "fx_points").groupBy("city", F.floor(F.col("lon") * 100).alias("cell_x"), F.floor(F.col("lat") * 100).alias("cell_y")).agg(F.count(F.lit(1)).alias("n_points"))




@query(
    "image_density",
    "city n_images:i area_km2:f per_km2:f verdict",
    f"""SELECT *, n_images / area_km2 AS per_km2, CASE WHEN n_images / area_km2 >= 5 THEN 'GO' ELSE 'NO' END AS verdict FROM (SELECT city, n AS n_images,
    {hav("a", "b").replace("a.lat", "((s + n_) / 2)").replace("b.lat", "((s + n_) / 2)").replace("a.lon", "w").replace("b.lon", "e")} * {hav("a", "b").replace("a.lat", "s").replace("b.lat", "n_").replace("a.lon", "((w + e) / 2)").replace("b.lon", "((w + e) / 2)")} / 1e6 AS area_km2
    FROM (SELECT city, count(DISTINCT label_id) AS n, min(lat) AS s, max(lat) AS n_, min(lon) AS w, max(lon) AS e FROM fx_ext_labels GROUP BY city))""",
)
def image_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different images in each city's box by its area, with a verdict at 5 a square kilometre."""
    box = load(spark, sf_dir, "fx_ext_labels").groupBy("city").agg(F.count_distinct("label_id").alias("n_images"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    box = box.withColumn("area_km2", geo.bbox_area_km2(F.col("w"), F.col("s"), F.col("e"), F.col("n")))
    return box.select("city", "n_images", "area_km2", (F.col("n_images") / F.col("area_km2")).alias("per_km2"), F.when(F.col("n_images") / F.col("area_km2") >= 5, "GO").otherwise("NO").alias("verdict"))
