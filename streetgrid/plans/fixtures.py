"""Views that give the driver's tables the shapes of geospatial benchmark data; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

VIEWS: dict[str, str] = {
    "fx_points": """
SELECT CAST(floor(c_custkey / 4e0) AS BIGINT) AS point_id,
       CASE c_custkey % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       CASE c_custkey % 4 WHEN 0 THEN 44.95e0 WHEN 1 THEN 47.60e0 WHEN 2 THEN 38.90e0 ELSE 40.44e0 END
         + ((c_custkey * 7919) % 10007) / 10007e0 * 5e-2 AS lat,
       CASE c_custkey % 4 WHEN 0 THEN -93.20e0 WHEN 1 THEN -122.33e0 WHEN 2 THEN -77.02e0 ELSE -79.98e0 END
         + ((c_custkey * 104729) % 9973) / 9973e0 * 5e-2 AS lon,
       c_custkey AS osmid,
       CAST(c_custkey % 6 AS INT) AS street_count
FROM customer
""",
    "fx_stops": """
SELECT p_partkey AS stop_id,
       CASE p_partkey % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       CASE p_partkey % 4 WHEN 0 THEN 44.95e0 WHEN 1 THEN 47.60e0 WHEN 2 THEN 38.90e0 ELSE 40.44e0 END
         + ((p_partkey * 6271) % 10009) / 10009e0 * 5e-2 AS stop_lat,
       CASE p_partkey % 4 WHEN 0 THEN -93.20e0 WHEN 1 THEN -122.33e0 WHEN 2 THEN -77.02e0 ELSE -79.98e0 END
         + ((p_partkey * 15485) % 9967) / 9967e0 * 5e-2 AS stop_lon,
       CAST(p_size % 5 AS INT) AS location_type
FROM part
""",
    "fx_segments": """
SELECT o_orderkey AS seg_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       CASE o_custkey % 6 WHEN 0 THEN 'footway' WHEN 1 THEN 'Sidewalk' WHEN 2 THEN 'residential'
                          WHEN 3 THEN 'steps' WHEN 4 THEN 'marked' ELSE NULL END AS class,
       CASE o_orderkey % 4 WHEN 0 THEN 44.95e0 WHEN 1 THEN 47.60e0 WHEN 2 THEN 38.90e0 ELSE 40.44e0 END
         + ((o_orderkey * 3571) % 10007) / 10007e0 * 5e-2 AS lat0,
       CASE o_orderkey % 4 WHEN 0 THEN -93.20e0 WHEN 1 THEN -122.33e0 WHEN 2 THEN -77.02e0 ELSE -79.98e0 END
         + ((o_orderkey * 2749) % 9973) / 9973e0 * 5e-2 AS lon0,
       (o_custkey % 201 - 100) * 1e-5 AS dlat,
       (o_orderkey % 151 - 75) * 1e-5 AS dlon
FROM orders
""",
    "fx_buildings": """
SELECT stop_id AS bld_id, city, stop_lat AS lat, stop_lon AS lon,
       CAST(5 + (stop_id * 31) % 25 AS DOUBLE) AS half_m
FROM fx_stops
""",
    "fx_edges": """
SELECT osmid AS u, osmid + 4 AS v, CAST(20 + (osmid * 37) % 90 AS DOUBLE) AS length FROM fx_points
UNION ALL
SELECT osmid AS u, osmid + 28 AS v, CAST(60 + (osmid * 53) % 200 AS DOUBLE) AS length FROM fx_points WHERE osmid % 3 = 0
UNION ALL
SELECT osmid + 4 AS u, osmid AS v, CAST(20 + (osmid * 37) % 90 AS DOUBLE) AS length FROM fx_points WHERE osmid % 2 = 0
""",
    "fx_stop_times": """
SELECT user_id AS trip_id, event_id % 200 + 1 AS stop_id,
       CASE WHEN event_id % 97 = 0 THEN 'bad'
            ELSE concat(CAST(hour(ts) + CASE WHEN event_id % 10 = 0 THEN 24 ELSE 0 END AS STRING),
                        ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':00') END AS departure_time
FROM events
""",
    "fx_trips": """
SELECT DISTINCT user_id AS trip_id, user_id % 5 AS service_id FROM events
""",
    "fx_calendar": """
SELECT CAST(s AS BIGINT) AS service_id, t AS tuesday, b AS start_date, e AS end_date FROM
 (VALUES (0,1,20240101,20241231),(1,0,20240101,20241231),(2,1,20230101,20231231),(3,1,20240301,20240630),(4,1,20240101,20240630)) AS q(s,t,b,e)
""",
    "fx_calendar_dates": """
SELECT CAST(s AS BIGINT) AS service_id, d AS date, x AS exception_type FROM
 (VALUES (0,20240312,2),(1,20240312,1),(4,20240319,2)) AS q(s,d,x)
""",
    "fx_mask_stats": """
SELECT p.city, p.point_id, h.heading,
       ((p.osmid * 17 + h.heading) % 101) / 500e0 AS sidewalk_frac,
       ((p.osmid * 29 + h.heading) % 97) / 2000e0 AS crosswalk_frac,
       ((p.osmid * 43 + h.heading) % 89) / 100e0 AS vegetation_frac,
       CASE WHEN (p.osmid + h.heading) % 7 = 0 THEN 0e0 ELSE ((p.osmid * 11) % 300) / 1e0 END AS sidewalk_width_px,
       CASE WHEN (p.osmid + h.heading) % 13 = 0 THEN 0e0 ELSE 9e-1 END AS mask_coverage
FROM fx_points p CROSS JOIN (SELECT 0 AS heading UNION ALL SELECT 90 UNION ALL SELECT 180 UNION ALL SELECT 270) h
""",
    "fx_captions": """
SELECT doc_id AS seq, CAST(floor(doc_id / 4e0) AS BIGINT) % 230 AS point_id,
       CASE doc_id % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       concat('sidewalk=', CASE n_chars % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one_side' WHEN 2 THEN 'both_sides' ELSE 'unknown' END,
              ', crosswalk=', CASE n_chars % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' ELSE 'unknown' END,
              ', traffic=', CASE n_chars % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'med' WHEN 2 THEN 'high' ELSE 'unknown' END,
              ', tree_canopy=', CASE n_chars % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'sparse' WHEN 2 THEN 'moderate' WHEN 3 THEN 'dense' ELSE 'unknown' END,
              ', land_use=', CASE n_chars % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial|residential' ELSE 'unknown' END,
              ', transit_stop=', CASE n_chars % 7 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'absent' ELSE 'unknown' END) AS answer
FROM documents
""",
    "fx_ext_labels": """
SELECT o_orderkey AS label_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       CASE o_orderkey % 4 WHEN 0 THEN 44.95e0 WHEN 1 THEN 47.60e0 WHEN 2 THEN 38.90e0 ELSE 40.44e0 END
         + ((o_orderkey * 5171) % 10007) / 10007e0 * 5e-2 AS lat,
       CASE o_orderkey % 4 WHEN 0 THEN -93.20e0 WHEN 1 THEN -122.33e0 WHEN 2 THEN -77.02e0 ELSE -79.98e0 END
         + ((o_orderkey * 4447) % 9973) / 9973e0 * 5e-2 AS lon,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'CurbRamp' WHEN '2-HIGH' THEN 'Crosswalk' WHEN '3-MEDIUM' THEN 'NoSidewalk'
                            WHEN '4-NOT SPECIFIED' THEN 'NoCurbRamp' ELSE 'Obstacle' END AS label_type
FROM orders
""",
    "fx_predictions": """
SELECT b.backbone, s.seed, o_orderkey AS point_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' WHEN 2 THEN 'dc' ELSE 'pittsburgh' END AS city,
       CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_bin,
       o_totalprice AS y_reg,
       ((o_custkey * b.k + o_orderkey * s.seed) % 50) / 5e1
         + CASE WHEN o_orderstatus = 'F' THEN b.lift ELSE 0e0 END + floor(o_totalprice / 1e4) / 1e2 AS score
FROM orders
CROSS JOIN (SELECT 'siglip' AS backbone, 7 AS k, 2e-1 AS lift UNION ALL SELECT 'clip', 13, 1e-1) b
CROSS JOIN (SELECT 41 AS seed UNION ALL SELECT 42 UNION ALL SELECT 43) s
""",
    "fx_run_log": """
SELECT o_orderkey AS run_index, o_orderdate AS ts,
       CASE o_orderstatus WHEN 'F' THEN 'siglip' WHEN 'O' THEN 'clip' ELSE 'siglip_lora_loco_dc' END AS backbone,
       CASE o_orderkey % 3 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' ELSE 'dc' END AS train_city,
       CASE o_custkey % 3 WHEN 0 THEN 'msp' WHEN 1 THEN 'seattle' ELSE 'dc' END AS test_city,
       CASE o_orderkey % 2 WHEN 0 THEN 'full' ELSE 'vision_only' END AS ablation,
       CAST(50 + o_orderkey % 200 AS INT) AS n,
       5e-1 + (o_custkey % 100) / 250e0 AS auroc
FROM orders
""",
    "fx_annotators": """
SELECT doc_id, quality AS rater_a, 1 - toxic AS rater_b FROM labels
""",
}


def _needed(sql: str) -> list[str]:
    """Views that a query names, and those that these name, inner ones first."""
    found: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in found:
                add(VIEWS[name])
                if name not in found:
                    found.append(name)

    add(sql)
    return found


def with_views(sql: str) -> str:
    """The query with the views it needs in front of it."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    body = sql.strip()
    recursive = re.match(r"WITH RECURSIVE\b", body, re.I)
    if m := re.match(r"WITH(?: RECURSIVE)?\b", body, re.I):
        parts.append(body[m.end() :].strip())
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(f"SELECT * FROM {name}")
    for table in TABLES:
        sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", sql)
    return spark.sql(sql)
