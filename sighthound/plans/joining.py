"""Cross-camera likeness, overlap in time, nearness and one-to-one matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import dot, range_iou
from ..functions.text import rounded
from ..operators.joins import greedy_match, nearest, overlapping_boxes, similar_pairs
from ..operators.stateful import first_returns
from ..operators.tracks import TRACKLETS_SQL as T
from ..operators.tracks import tracklets
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import GALLERY_SQL as G
from ..sources.tables import detections, gallery, table


def cross_camera_pairs(spark, sf):
    return similar_pairs(gallery(spark, sf), 0.3).select("a", "b", rounded("similarity", 6).alias("similarity"))


def overlap_iou(spark, sf):
    """Tracklets of a camera and type that overlap in time and in the picture."""
    t = tracklets(detections(spark, sf))
    # The limit holds for the rounded overlap.
    j = overlapping_boxes(t, ["camera", "entity_type"], "first_ts", "last_ts", ["track_id", "segment"], 0.249999, 86400.0)
    j = j.withColumn("iou", rounded("iou", 6)).filter("a_track_id <> b_track_id and iou >= 0.25")
    side = lambda p, q: [F.when(F.col("a_track_id") < F.col("b_track_id"), F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")) for c in ("track_id", "segment")]
    return j.select(*[x.alias(n) for x, n in zip((*side("a", "b"), *side("b", "a")), ("a_track_id", "a_segment", "b_track_id", "b_segment"), strict=True)], "iou")


def time_overlap(spark, sf):
    """Overlap in frames of the extents of tracks with those of the same tracks as moved by an hour."""
    e = detections(spark, sf).groupBy("camera", "track_id").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"))
    return e.select("camera", "track_id", rounded(range_iou("f0", "f1", F.col("f0") + 60, F.col("f1") + 60), 6).alias("iou"))


def asof_person_vehicle(spark, sf):
    """For each sighting of a vehicle the person on the same camera who is nearest in time, at most 600 s away."""
    d = detections(spark, sf)
    v = d.filter("entity_type = 'vehicle'").select("camera", F.col("event_id").alias("vehicle_event"), F.col("ts_sec").alias("v_ts"))
    p = d.filter("entity_type = 'person'").select("camera", F.col("event_id").alias("person_event"), F.col("ts_sec").alias("p_ts"))
    return nearest(v, p, ["camera"], "v_ts", "p_ts", 600.0, ["person_event"]).select("vehicle_event", "person_event", rounded("gap", 6).alias("gap"))


def poi_probe(spark, sf):
    """Persons of the gallery by likeness to vector 0."""
    g = gallery(spark, sf)
    probe = g.filter("vec_id = 0").select(F.col("embedding").alias("probe"), F.lit(1).alias("one"))
    s = g.filter("entity_type = 'person'").withColumn("one", F.lit(1)).join(F.broadcast(probe), "one").withColumn("similarity", rounded(dot("embedding", "probe"), 6))
    return s.filter("similarity >= 0.2").select("vec_id", "camera", "similarity")


def vehicle_topk(spark, sf):
    g = gallery(spark, sf)
    probe = g.filter("vec_id = 0").select(F.col("embedding").alias("probe"), F.lit(1).alias("one"))
    s = g.filter("entity_type = 'vehicle'").withColumn("one", F.lit(1)).join(F.broadcast(probe), "one").withColumn("similarity", rounded(dot("embedding", "probe"), 6))
    return s.orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", "similarity")


def unmatched(spark, sf):
    """Customers without an order of high priority in its first month: the anti join."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' and month(o_orderdate) = 1")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_nationkey")


def greedy(spark, sf):
    """One-to-one matches between two cameras by falling likeness."""
    g = gallery(spark, sf)
    pairs = similar_pairs(g.filter(F.col("camera").isin("cam0", "cam1")), 0.3)
    flip = F.col("a") % 4 == 0
    pairs = pairs.select(F.when(flip, F.col("a")).otherwise(F.col("b")).alias("i"), F.when(flip, F.col("b")).otherwise(F.col("a")).alias("j"), rounded("similarity", 6).alias("s"))
    return greedy_match(pairs, "i", "j", "s")


def camera_sites(spark, sf):
    """Detections by site: the dimension join."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("sites"), rounded(F.avg("s_acctbal"), 4).alias("mean"))


def round_trips(spark, sf):
    """Departures (purchases) of each user in order, each with the first later return (click) within a day that none before it has."""
    d = detections(spark, sf).filter(F.col("class_name").isin("purchase", "click"))
    got = first_returns(d.select("track_id", F.col("event_id").alias("id"), "ts_sec", (F.col("class_name") == "click").alias("back")), "track_id", 86400.0)
    return got.select("track_id", "dep", "arr", rounded("away", 6).alias("away"))


PLANS = {
    "cross_camera_pairs": (cross_camera_pairs, f"WITH {G}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS s FROM g AS x JOIN g AS y ON x.vec_id < y.vec_id AND x.camera <> y.camera) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.3"),
    "interval_overlap_iou": (overlap_iou, f"""WITH {D}, {T}, j AS (SELECT a.track_id AS a_track_id, a.segment AS a_segment, b.track_id AS b_track_id, b.segment AS b_segment, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0) AS i,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM t AS a JOIN t AS b ON a.camera = b.camera AND a.entity_type = b.entity_type AND a.track_id < b.track_id AND a.first_ts <= b.last_ts AND b.first_ts <= a.last_ts)
 SELECT a_track_id, a_segment, b_track_id, b_segment, round(i / (u - i), 6) AS iou FROM j WHERE round(i / (u - i), 6) >= 0.25"""),
    "temporal_iou": (time_overlap, f"""WITH {D}, e AS (SELECT camera, track_id, min(frame_idx) AS f0, max(frame_idx) AS f1 FROM d GROUP BY ALL), i AS (SELECT *, greatest(f1 - f0 - 60, 0) AS i FROM e)
 SELECT camera, track_id, CASE WHEN 2 * (f1 - f0) - i > 0 THEN round(i / (2 * (f1 - f0) - i)::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS iou FROM i"""),
    "asof_person_vehicle": (asof_person_vehicle, f"""WITH {D}, j AS (SELECT v.event_id AS vehicle_event, p.event_id AS person_event, abs(v.ts_sec - p.ts_sec) AS gap FROM d AS v JOIN d AS p ON v.camera = p.camera AND v.entity_type = 'vehicle' AND p.entity_type = 'person' AND abs(v.ts_sec - p.ts_sec) <= 600)
 SELECT vehicle_event, first(person_event ORDER BY gap, person_event) AS person_event, round(min(gap), 6) AS gap FROM j GROUP BY vehicle_event"""),
    "poi_probe": (poi_probe, f"WITH {G} SELECT x.vec_id, x.camera, round(list_dot_product(x.v, y.v), 6) AS similarity FROM g AS x, g AS y WHERE y.vec_id = 0 AND x.entity_type = 'person' AND round(list_dot_product(x.v, y.v), 6) >= 0.2"),
    "vehicle_topk": (vehicle_topk, f"WITH {G} SELECT x.vec_id, round(list_dot_product(x.v, y.v), 6) AS similarity FROM g AS x, g AS y WHERE y.vec_id = 0 AND x.entity_type = 'vehicle' ORDER BY similarity DESC, x.vec_id LIMIT 10"),
    "unmatched_anti": (unmatched, "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND month(o_orderdate) = 1)"),
    "camera_sites": (camera_sites, "SELECT n_name, count(*) AS sites, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
    "greedy_match": (greedy, f"""WITH RECURSIVE {G}, p AS (SELECT x.vec_id AS i, y.vec_id AS j, list_dot_product(x.v, y.v) AS r FROM g AS x JOIN g AS y ON x.camera = 'cam0' AND y.camera = 'cam1'), o AS (SELECT i, j, round(r, 6) AS s, row_number() OVER (ORDER BY round(r, 6) DESC, i, j) AS n FROM p WHERE r >= 0.3),
 f(n, ui, uj, ok, i, j, s) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE UNION ALL
 SELECT o.n, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN ui ELSE list_append(ui, o.i) END, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN uj ELSE list_append(uj, o.j) END, NOT (list_contains(ui, o.i) OR list_contains(uj, o.j)), o.i, o.j, o.s FROM f JOIN o ON o.n = f.n + 1)
 SELECT i, j, s FROM f WHERE ok"""),
    "round_trips": (round_trips, f"""WITH RECURSIVE {D}, r AS (SELECT track_id, list(struct_pack(t := ts_sec, e := event_id) ORDER BY ts_sec, event_id) AS back FROM d WHERE class_name = 'click' GROUP BY track_id),
 o AS (SELECT track_id, event_id, ts_sec, row_number() OVER (PARTITION BY track_id ORDER BY ts_sec, event_id) AS n FROM d WHERE class_name = 'purchase'),
 f AS (SELECT track_id, 0::BIGINT AS n, back AS free, NULL::BIGINT AS dep, NULL::BIGINT AS arr, NULL::DOUBLE AS away FROM r UNION ALL
 SELECT track_id, n, CASE WHEN hit.t - ts_sec <= 86400 THEN list_filter(free, lambda x: x.e <> hit.e) ELSE free END, event_id, CASE WHEN hit.t - ts_sec <= 86400 THEN hit.e END, hit.t - ts_sec
 FROM (SELECT f.track_id, o.n, free, o.event_id, o.ts_sec, list_filter(free, lambda x: x.t > o.ts_sec)[1] AS hit FROM f JOIN o ON o.track_id = f.track_id AND o.n = f.n + 1))
 SELECT track_id, dep, arr, round(away, 6) AS away FROM f WHERE arr IS NOT NULL"""),
}
