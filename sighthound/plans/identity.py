"""Identities, journeys and evaluation over the tracklets of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import temporal_bonus
from ..functions.text import rounded
from ..operators import identities as I
from ..operators.evaluation import match_truth, reid_counts, tracking_scores
from ..operators.evidence import archive_names, case_summary, journey_steps, manifest_totals
from ..operators.graph import components
from ..operators.joins import alike_boxes, similar_pairs
from ..operators.stateful import led_clusters, merge_fragments, reading_order, spatial_leaders
from ..operators.tracks import TRACKLETS_SQL as T
from ..operators.tracks import tracklets
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import GALLERY_SQL as G
from ..sources.tables import detections, gallery, table

#: The vectors of the test tables are near random and their clips last a month, so matches need less likeness, edges are shorter and journeys' gaps longer than with real ones.
LIMITS = I.Limits(person=0.40, vehicle=0.40, edge=0.001, brief_edge=0.001, journey_gap=7200.0)


def entities(spark, sf):
    """Tracklets with the appearance vector of their track; a track without one keeps a null."""
    t = tracklets(detections(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding"), "track_id", "left")
    return t.select((F.col("track_id") * 10000 + F.col("segment")).alias("entity_id"), "camera", "entity_type", F.col("class_name").alias("description"), "first_ts", "last_ts", "x1", "y1", "x2", "y2", F.col("class_name").alias("upper"), F.col("entity_type").alias("lower"), "embedding")


def _two(spark, sf):
    return entities(spark, sf).filter(F.col("camera").isin("cam0", "cam1"))


def _resolved(spark, sf):
    e = I.durable(_two(spark, sf))
    matches = I.durable(I.match_cameras(e, "cam0", "cam1", LIMITS))
    found = I.durable(I.identities(e, matches, LIMITS))
    return e, matches, found, I.durable(I.sightings(e, found, LIMITS))


def match_across(spark, sf):
    """Matches one to one of two cameras."""
    return I.match_cameras(_two(spark, sf), "cam0", "cam1", LIMITS)


def identities(spark, sf):
    return _resolved(spark, sf)[3].select("entity_type", "unified_id", "camera", "first_ts", "last_ts", "entity_id", "matched")


def journeys(spark, sf):
    e, _, found, seen = _resolved(spark, sf)
    return I.journeys(I.events(e, seen, LIMITS), seen, I.directions(e, found), LIMITS)


def linked_trips(spark, sf):
    return I.round_trips(I.durable(journeys(spark, sf)), LIMITS)


def pair_scores(spark, sf):
    """Likeness plus nearness in time of vectors on different cameras, each seen for a minute at its own time."""
    g = gallery(spark, sf)
    t = g.select("vec_id", (F.col("vec_id") * 7.0).alias("t0"), (F.col("vec_id") * 7.0 + 60).alias("t1"))
    p = similar_pairs(g, 0.3)
    for s in "ab":
        p = p.join(t.select(F.col("vec_id").alias(s), F.col("t0").alias(f"{s}0"), F.col("t1").alias(f"{s}1")), s)
    return p.select("a", "b", rounded(F.col("similarity") + temporal_bonus("a0", "a1", "b0", "b1"), 6).alias("score"))


def within_camera_best(spark, sf):
    """Best likeness of each vector to another of its camera."""
    p = similar_pairs(gallery(spark, sf), 0.25, same_camera=True)
    return p.select(F.explode(F.array("a", "b")).alias("vec_id"), "similarity").groupBy("vec_id").agg(rounded(F.max("similarity"), 6).alias("best"))


def linked_groups(spark, sf):
    """Vectors that hang together by likeness over cameras."""
    p = similar_pairs(gallery(spark, sf), 0.38)
    return components(p).select("node", "root")


def parked_boxes(spark, sf):
    """Tracks of a camera whose mean boxes overlap by more than half."""
    b = detections(spark, sf).groupBy("camera", "track_id").agg(*[F.avg(c).cast("long").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return alike_boxes(b, "camera", "track_id").select("a", "b", rounded("iou", 6).alias("iou"))


def fragments(spark, sf):
    t = tracklets(detections(spark, sf)).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding"), "track_id", "left")
    return merge_fragments(t.withColumn("key", F.col("track_id") * 10000 + F.col("segment")))


def spatial(spark, sf):
    """Clusters of one frame's boxes around its most certain ones."""
    return spatial_leaders(detections(spark, sf), ["camera", "frame_idx"], "event_id", 100.0)


def cluster_list(spark, sf):
    """Clusters of each camera and frame with their sizes, in reading order."""
    d = detections(spark, sf)
    return led_clusters(d, spatial(spark, sf), ["camera", "frame_idx"], "event_id").select("camera", "frame_idx", "event_id", "num_detections", "place")


def places(spark, sf):
    """Boxes of each camera and class in reading order."""
    return reading_order(detections(spark, sf), ["camera", "class_name", "frame_idx"], "event_id").select("event_id", "place")


def _truth(spark, sf):
    """Track extents as truth, and the same moved by an hour as what a system saw."""
    x = detections(spark, sf).groupBy("camera", "track_id").agg(F.min("frame_idx").alias("f0"), F.max("frame_idx").alias("f1"))
    return x.select("camera", F.col("track_id").alias("gt_id"), "f0", "f1"), x.select("camera", F.col("track_id").alias("sys_id"), (F.col("f0") + F.col("track_id") % 90).alias("f0"), (F.col("f1") + 30).alias("f1"))


def gt_match(spark, sf):
    return match_truth(*_truth(spark, sf)).select("gt_id", "sys_id", rounded("iou", 6).alias("iou"))


def tracking_quality(spark, sf):
    gt, system = _truth(spark, sf)
    return tracking_scores(gt, system, match_truth(gt, system))


def reid_eval(spark, sf):
    """Pairs of neighbouring tracks as true persons, identities as the system's answer."""
    _, _, found, _ = _resolved(spark, sf)
    seen = _two(spark, sf).select(F.col("entity_id"), "camera")
    claims = found.join(seen, "entity_id").filter("entity_type = 'person'").select(F.col("root").alias("identity"), F.floor(F.col("entity_id") / 20000).alias("gt"), "camera")
    return reid_counts(claims)


def case_file(spark, sf):
    """Counts of the case: identities, those on several cameras, returns."""
    e, _, found, seen = _resolved(spark, sf)
    made = I.durable(I.journeys(I.events(e, seen, LIMITS), seen, I.directions(e, found), LIMITS))
    return case_summary(seen, I.round_trips(made, LIMITS))


def steps(spark, sf):
    e, _, found, seen = _resolved(spark, sf)
    return journey_steps(I.durable(I.journeys(I.events(e, seen, LIMITS), seen, I.directions(e, found), LIMITS)), seen)


def evidence_totals(spark, sf):
    return manifest_totals(table(spark, sf, "documents").select(F.octet_length("text").cast("long").alias("size_bytes")))


def crop_names(spark, sf):
    """Names of the pictures of the persons' segments, a track standing for an identity."""
    t = tracklets(detections(spark, sf)).filter("entity_type = 'person'")
    s = t.select(F.col("track_id").alias("unified_id"), "camera", "first_ts", F.col("segment").alias("entity_id"), F.concat(F.lit("/crops/"), F.col("class_name"), F.lit(".jpg")).alias("crop_path"))
    return archive_names(s, "person").select("unified_id", "entity_id", "archive_name")


PLANS = {
    "case_file": case_file,
    "journey_steps": steps,
    "evidence_totals": (evidence_totals, "SELECT count(*) AS total_files, sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents"),
    "crop_names": (crop_names, f"""WITH {D}, {T} SELECT track_id AS unified_id, segment AS entity_id, 'crops/persons/P' || track_id || '_sighting_' || row_number() OVER (PARTITION BY track_id ORDER BY first_ts, segment) || '_' || camera || '.jpg' AS archive_name FROM t WHERE entity_type = 'person'"""),
    "cross_camera_score": (pair_scores, f"""WITH {G}, p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS s, x.vec_id * 7.0::DOUBLE AS a0, x.vec_id * 7.0::DOUBLE + 60 AS a1, y.vec_id * 7.0::DOUBLE AS b0, y.vec_id * 7.0::DOUBLE + 60 AS b1 FROM g AS x JOIN g AS y ON x.vec_id < y.vec_id AND x.camera <> y.camera),
 q AS (SELECT a, b, s, least(abs(a0 - b0), abs(a0 - b1), abs(a1 - b0), abs(a1 - b1)) AS gap FROM p WHERE s >= 0.3) SELECT a, b, round(s + CASE WHEN gap < 300 THEN 0.15::DOUBLE * (1 - gap / 300) ELSE 0 END, 6) AS score FROM q"""),
    "within_camera_best": (within_camera_best, f"WITH {G}, p AS (SELECT x.vec_id, list_dot_product(x.v, y.v) AS s FROM g AS x JOIN g AS y ON x.vec_id <> y.vec_id AND x.camera = y.camera) SELECT vec_id, round(max(s), 6) AS best FROM p WHERE s >= 0.25 GROUP BY vec_id"),
    "components": (linked_groups, f"""WITH RECURSIVE {G}, p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g AS x JOIN g AS y ON x.vec_id <> y.vec_id AND x.camera <> y.camera WHERE list_dot_product(x.v, y.v) >= 0.38),
 r(node, seen) AS (SELECT a, a FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.seen = p.a) SELECT node, min(seen) AS root FROM r GROUP BY node"""),
    "parked_boxes": (parked_boxes, f"""WITH {D}, b AS (SELECT camera, track_id, trunc(avg(x1)) AS x1, trunc(avg(y1)) AS y1, trunc(avg(x2)) AS x2, trunc(avg(y2)) AS y2 FROM d GROUP BY ALL),
 j AS (SELECT a.track_id AS a, b.track_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM b AS a JOIN b ON a.camera = b.camera AND a.track_id < b.track_id)
 SELECT a, b, round(i / (u - i), 6) AS iou FROM j WHERE i / (u - i) > 0.5"""),
    "match_across": match_across,
    "identities": identities,
    "journeys": journeys,
    "linked_trips": linked_trips,
    "fragment_merge": fragments,
    "spatial_cluster": spatial,
    "cluster_list": cluster_list,
    "reading_order": (places, f"WITH {D} SELECT event_id, row_number() OVER (PARTITION BY camera, class_name, frame_idx ORDER BY y1, x1, event_id)::INTEGER AS place FROM d"),
    "gt_match": gt_match,
    "tracking_quality": tracking_quality,
    "reid_eval": reid_eval,
}
