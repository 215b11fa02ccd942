"""Filters, summaries, integrity and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators.evaluation import score_columns
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import detections, table


def filter_detections(d, class_name: str | None = None, min_conf: float = 0.0, start: float | None = None, end: float | None = None):
    """Detections by class, least confidence and inclusive time bounds. An empty class and 0 confidence mean no predicate; time bounds of 0 are bounds."""
    if class_name:
        d = d.filter(F.col("class_name") == class_name)
    if min_conf:
        d = d.filter(F.col("conf") >= min_conf)
    if start is not None:
        d = d.filter(F.col("ts_sec") >= start)
    return d if end is None else d.filter(F.col("ts_sec") <= end)


def detections_filter(spark, sf):
    d = filter_detections(detections(spark, sf), "click", 0.5, 1000.0, 900000.0)
    return d.select("event_id", "camera", "frame_idx", "ts_sec", F.array_join(F.transform(F.array("x1", "y1", "x2", "y2"), lambda x: x.cast("long").cast("string")), ",").alias("bbox")).orderBy("ts_sec", "event_id")


def distinct_cameras(spark, sf):
    return detections(spark, sf).select("camera").distinct().orderBy("camera")


def entity_search(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(F.col("p_name").ilike("%a%") & F.col("p_size").between(5, 20) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13")).select("p_partkey", "p_name", "p_brand")


def class_gates(spark, sf):
    d = detections(spark, sf)
    least = F.when(F.col("entity_type") == "person", 0.25).otherwise(0.30)
    return d.filter(F.col("conf") >= least).groupBy("camera", "entity_type").agg(F.count("*").alias("n"))


#: Least and greatest aspect ratio, least width, least height.
PLATE_PRESETS = {"reader": (0.5, 12.0, 30, 10), "tracker": (1.5, 8.0, 15, 5), "tiled": (2.0, 7.0, 30, 8), "two_stage": (1.5, 8.0, 20, 5)}


def plate_ok(w: Column, h: Column, preset: str) -> Column:
    low, high, width, height = PLATE_PRESETS[preset]
    ratio = F.when(h > 0, w / h).otherwise(0.0)
    return ratio.between(low, high) & (w >= width) & (h >= height)


def plate_presets(spark, sf):
    d = detections(spark, sf)
    return d.groupBy("camera").agg(*[F.count_if(plate_ok(F.col("w"), F.col("h"), p)).alias(p) for p in PLATE_PRESETS])


def report_summary(spark, sf):
    frames = detections(spark, sf).groupBy("camera", "frame_idx").agg(F.count("*").alias("c"), F.min("ts_sec").alias("lo"), F.max("ts_sec").alias("hi"))
    return frames.groupBy("camera").agg(F.count("*").alias("frames"), F.sum("c").alias("detections"), F.min("lo").alias("start_ts"), F.max("hi").alias("end_ts"))


def class_stats(spark, sf):
    """Per class: how many, and when first and last seen; ties go to the detection that came first."""
    first, last = F.struct("frame_idx", "event_id"), F.struct("frame_idx", -F.col("event_id"))
    d = detections(spark, sf).groupBy("class_name").agg(
        F.count("*").alias("n"), F.min("frame_idx").alias("first_frame"), F.min_by("ts_sec", first).alias("first_ts"), F.max("frame_idx").alias("last_frame"), F.max_by("ts_sec", last).alias("last_ts")
    )
    return d.orderBy("class_name")


def risk_flags(spark, sf):
    d = detections(spark, sf)
    level = F.when(F.col("conf") > 0.98, "critical").when(F.col("conf") > 0.9, "warning").otherwise("info")
    return d.withColumn("severity", level)


def risk_class(spark, sf):
    """Risk ladder over the counts of severities of each track's flags."""
    g = risk_flags(spark, sf).groupBy("track_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.count_if(F.col("severity") == "info").alias("info"))
    c, w = F.col("critical"), F.col("warning")
    risk = F.when(c >= 2, "high").when((c == 1) | (w >= 3), "medium").when(w >= 1, "low").otherwise("clean")
    sure = F.when(c >= 2, F.least(0.5 + 0.1 * c, F.lit(1.0))).when(c == 1, 0.7).when(w >= 3, 0.6).when(w >= 1, 0.5).otherwise(0.9)
    return g.withColumn("risk", risk).withColumn("confidence", rounded(sure, 6))


def motion_ratio(spark, sf):
    d = detections(spark, sf).withColumn("has_motion", F.col("conf") >= 0.3)
    return d.groupBy("camera").agg(F.count_if("has_motion").alias("with_motion"), rounded(F.avg(F.col("has_motion").cast("double")), 6).alias("ratio"))


def eval_prf(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source")
    g = g.agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("tp"), F.count_if(F.expr("quality = 1 and toxic = 1")).alias("fp"), F.count_if(F.expr("quality = 0 and toxic = 0")).alias("fn"))
    return g.withColumns(score_columns(F.col("tp"), F.col("fp"), F.col("fn"))).withColumnRenamed("f1_score", "f1")


def grid_hist(spark, sf, cell: int = 50):
    """Detections within ``cell`` of each occupied grid cell's origin: a cell sees the four cells around it only."""
    d = detections(spark, sf).select("camera", "event_id", "x1", "y1", F.floor(F.col("x1") / cell).alias("gx"), F.floor(F.col("y1") / cell).alias("gy"))
    cells = d.select("camera", "gx", "gy").distinct()
    near = cells.withColumn("dx", F.explode(F.array(F.lit(-1), F.lit(0)))).withColumn("dy", F.explode(F.array(F.lit(-1), F.lit(0))))
    near = near.select("camera", F.col("gx").alias("cx"), F.col("gy").alias("cy"), (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    hit = near.join(d, ["camera", "gx", "gy"]).filter((F.abs(F.col("x1") - F.col("cx") * cell) < cell) & (F.abs(F.col("y1") - F.col("cy") * cell) < cell))
    return hit.groupBy("camera", "cx", "cy").agg(F.count("*").alias("n"))


def manifest_verify(spark, sf):
    """Stored against present hashes: MATCH, MISMATCH or NOT_FOUND, by path or hash, the first entry of the manifest counting."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.concat(F.lit("/v/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"))
    manifest = docs.filter("n_chars <= 2000").select(F.col("doc_id").alias("ord"), F.col("path").alias("m_path"), F.when(F.col("n_chars") < 200, F.sha2("path", 256)).otherwise(F.col("sha")).alias("m_sha"))
    by_path = docs.join(manifest, F.col("path") == F.col("m_path")).select("doc_id", "ord", "m_sha")
    by_sha = docs.join(manifest, F.col("sha") == F.col("m_sha")).select("doc_id", "ord", "m_sha")
    first = by_path.unionByName(by_sha).groupBy("doc_id").agg(F.min("ord").alias("ord"), F.min_by("m_sha", "ord").alias("m_sha"))
    state = F.when(F.col("m_sha").isNull(), "NOT_FOUND").when(F.col("m_sha") == F.col("sha"), "MATCH").otherwise("MISMATCH")
    return docs.join(first, "doc_id", "left").select("doc_id", "ord", state.alias("state"))


def hash_dupes(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return g.filter("n > 1")


def severity_rollup(spark, sf):
    return risk_flags(spark, sf).rollup("camera", "severity").agg(F.count("*").alias("n"))


def metadata_props(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("props").alias("with_props"), F.countDistinct(F.sha2("props", 256)).alias("n_distinct"))


def latest_run(spark, sf):
    return detections(spark, sf).groupBy("camera").agg(F.max_by("track_id", F.struct("ts_sec", "event_id")).alias("track_id"), F.max("ts_sec").alias("ts_sec"))


RISK = f"WITH {D}, f AS (SELECT *, CASE WHEN conf > 0.98 THEN 'critical' WHEN conf > 0.9 THEN 'warning' ELSE 'info' END AS severity FROM d)"
P = "w / h BETWEEN {} AND {} AND w >= {} AND h >= {}"
PLANS = {
    "class_stats": (class_stats, f"WITH {D} SELECT class_name, count(*) AS n, min(frame_idx) AS first_frame, first(ts_sec ORDER BY frame_idx, event_id) AS first_ts, max(frame_idx) AS last_frame, first(ts_sec ORDER BY frame_idx DESC, event_id) AS last_ts FROM d GROUP BY class_name"),
    "detections_filter": (detections_filter, f"WITH {D} SELECT event_id, camera, frame_idx, ts_sec, concat_ws(',', x1::BIGINT, y1::BIGINT, x2::BIGINT, y2::BIGINT) AS bbox FROM d WHERE class_name = 'click' AND conf >= 0.5 AND ts_sec >= 1000.0 AND ts_sec <= 900000.0"),
    "distinct_cameras": (distinct_cameras, f"WITH {D} SELECT DISTINCT camera FROM d"),
    "entity_search": (entity_search, "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%a%' AND p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')"),
    "class_gates": (class_gates, f"WITH {D} SELECT camera, entity_type, count(*) AS n FROM d WHERE conf >= CASE WHEN entity_type = 'person' THEN 0.25 ELSE 0.30 END GROUP BY ALL"),
    "plate_presets": (plate_presets, f"WITH {D} SELECT camera, " + ", ".join(f"count(*) FILTER ({P.format(*v)}) AS {k}" for k, v in PLATE_PRESETS.items()) + " FROM d GROUP BY camera"),
    "report_summary": (report_summary, f"WITH {D} SELECT camera, count(DISTINCT frame_idx) AS frames, count(*) AS detections, min(ts_sec) AS start_ts, max(ts_sec) AS end_ts FROM d GROUP BY camera"),
    "risk_class": (risk_class, RISK + """, g AS (SELECT track_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM f GROUP BY track_id)
 SELECT *, CASE WHEN critical >= 2 THEN 'high' WHEN critical = 1 OR warning >= 3 THEN 'medium' WHEN warning >= 1 THEN 'low' ELSE 'clean' END AS risk,
 round(CASE WHEN critical >= 2 THEN least(0.5::DOUBLE + 0.1::DOUBLE * critical, 1.0) WHEN critical = 1 THEN 0.7 WHEN warning >= 3 THEN 0.6 WHEN warning >= 1 THEN 0.5 ELSE 0.9 END::DOUBLE, 6) AS confidence FROM g"""),
    "severity_rollup": (severity_rollup, RISK + " SELECT camera, severity, count(*) AS n FROM f GROUP BY ROLLUP (camera, severity)"),
    "motion_ratio": (motion_ratio, f"WITH {D} SELECT camera, count(*) FILTER (conf >= 0.3) AS with_motion, round(avg((conf >= 0.3)::INTEGER::DOUBLE), 6) AS ratio FROM d GROUP BY camera"),
    "eval_prf": (eval_prf, """WITH g AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY source),
 h AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM g)
 SELECT source, tp, fp, fn, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM h"""),
    "grid_hist": (grid_hist, f"WITH {D}, c AS (SELECT DISTINCT camera, floor(x1 / 50)::BIGINT AS cx, floor(y1 / 50)::BIGINT AS cy FROM d) SELECT c.camera, cx, cy, count(*) AS n FROM c JOIN d ON c.camera = d.camera AND abs(x1 - cx * 50) < 50 AND abs(y1 - cy * 50) < 50 GROUP BY ALL"),
    "manifest_verify": (manifest_verify, """WITH x AS (SELECT doc_id, n_chars, '/v/' || doc_id AS path, sha256(text) AS sha FROM documents),
 m AS (SELECT doc_id AS ord, path AS m_path, CASE WHEN n_chars < 200 THEN sha256(path) ELSE sha END AS m_sha FROM x WHERE n_chars <= 2000),
 j AS (SELECT doc_id, ord, m_sha FROM x JOIN m ON path = m_path UNION ALL SELECT doc_id, ord, m_sha FROM x JOIN m ON sha = m_sha),
 f AS (SELECT doc_id, min(ord) AS ord, min_by(m_sha, ord) AS m_sha FROM j GROUP BY doc_id)
 SELECT x.doc_id, f.ord, CASE WHEN m_sha IS NULL THEN 'NOT_FOUND' WHEN m_sha = sha THEN 'MATCH' ELSE 'MISMATCH' END AS state FROM x LEFT JOIN f ON x.doc_id = f.doc_id"""),
    "hash_dupes": (hash_dupes, "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "metadata_props": (metadata_props, "SELECT event_type, count(props) AS with_props, count(DISTINCT props) AS n_distinct FROM events GROUP BY event_type"),
    "latest_run": (latest_run, f"WITH {D} SELECT camera, first(track_id ORDER BY ts_sec DESC, event_id DESC) AS track_id, max(ts_sec) AS ts_sec FROM d GROUP BY camera"),
}
