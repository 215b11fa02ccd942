"""Tracks: segments, extents, representatives, time lines, quality of packet times."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import area
from ..functions.text import rounded
from ..operators.stateful import absorb_concurrent, iou_tracker, leader_dedup, running_spread
from ..operators.tracks import TRACKLETS_SQL as T
from ..operators.tracks import gap_split, majority, outliers, middle_detection, size_break, tracklets
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import detections, gallery, table


def gap_segments(spark, sf):
    return gap_split(detections(spark, sf), 360).select("event_id", "camera", "track_id", "segment")


def tracklet_extents(spark, sf):
    return tracklets(detections(spark, sf))


def bbox_split(spark, sf):
    return size_break(detections(spark, sf))


def entity_extent(spark, sf):
    return detections(spark, sf).groupBy("camera", "track_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n"))


def best_crop(spark, sf):
    """The surest detection of each track among those large enough; of equals the one met first."""
    gate = (F.col("w") >= 20) & (F.col("h") >= 30)
    best = F.max_by(F.struct("event_id", "conf"), F.struct("conf", -F.col("frame_idx"), -F.col("event_id")))
    return detections(spark, sf).filter(gate).groupBy("camera", "track_id").agg(best.alias("b")).select("camera", "track_id", "b.event_id", "b.conf")


def median_rep(spark, sf):
    return middle_detection(detections(spark, sf))


def color_vote(spark, sf):
    return majority(detections(spark, sf), "class_name")


def mean_bbox(spark, sf):
    return detections(spark, sf).groupBy("camera", "track_id").agg(*[(F.sum(c) / F.count(c)).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


def clip_bounds(spark, sf):
    return detections(spark, sf).groupBy("camera").agg(F.min("ts_sec").alias("clip_start"), F.greatest(F.lit(0.0), F.max("ts_sec")).alias("clip_end"))


def top5_area(spark, sf):
    w = W.partitionBy("camera", "track_id").orderBy(area().desc(), "event_id")
    return detections(spark, sf).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("camera", "track_id", "event_id", "rank")


def timeline_gaps(spark, sf):
    """Time between the segments of a track, where there is any."""
    w = W.partitionBy("track_id").orderBy("first_ts", "segment")
    t = tracklets(detections(spark, sf)).withColumn("gap", F.col("first_ts") - F.lag("last_ts").over(w))
    return t.filter("gap > 0").select("camera", "track_id", "segment", rounded("gap", 6).alias("gap"))


def onoff_summary(spark, sf):
    w = W.partitionBy("track_id").orderBy("first_ts", "segment")
    t = tracklets(detections(spark, sf)).withColumn("gap", F.col("first_ts") - F.lag("last_ts").over(w)).withColumn("on", F.col("last_ts") - F.col("first_ts"))
    return t.groupBy("track_id").agg(rounded(F.sum("on"), 4).alias("on_secs"), rounded(F.sum(F.when(F.col("gap") > 0, F.col("gap")).otherwise(0.0)), 4).alias("off_secs"), F.count_if(F.expr("gap > 0")).alias("gaps"), F.count("*").alias("sightings"), F.array_join(F.array_sort(F.collect_set("camera")), ", ").alias("cameras"))


def pts_gaps(spark, sf):
    """Steps of packet times in packet order that exceed the larger of three frames and 0.15 s; above 1 s critical."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "pts")
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 10000).alias("pts"))
    p = p.withColumn("step", F.lead("pts").over(w) - F.col("pts")).filter(F.col("step") > F.greatest(F.lit(3 / 25.0), F.lit(0.15)))
    return p.select("l_orderkey", "l_linenumber", rounded("step", 6).alias("step"), F.when(F.col("step") > 1, "critical").otherwise("warning").alias("severity"))


def gop_cv(spark, sf):
    """Spread of the distances of key frames by user; three key frames at least, an anomaly above half of the mean."""
    w = W.partitionBy("track_id").orderBy("ts_sec", "event_id")
    p = detections(spark, sf).withColumn("line", F.row_number().over(w)).filter("class_name = 'click'")
    p = p.withColumn("gop", F.col("line") - F.lag("line").over(w))
    # A key frame without one before it has no distance, so keys are one more than distances.
    g = running_spread(p, "track_id", ["ts_sec", "event_id"], "gop").filter("n >= 2")
    cv = F.try_divide("deviation", "mean")
    return g.select("track_id", (F.col("n") + 1).alias("keys"), rounded(cv, 6).alias("cv"), (cv > 0.5).alias("anomaly"))


def zscore_outliers(spark, sf):
    """Values more than three standard deviations off the mean of all."""
    e = outliers(table(spark, sf, "events").select("event_id", "value"), "value")
    return e.select("event_id", rounded("z", 5).alias("z"), rounded("confidence", 5).alias("confidence"))


def spread(spark, sf):
    return detections(spark, sf).groupBy("camera").agg(F.median("conf").alias("median"), rounded(F.avg("conf"), 6).alias("mean"), rounded(F.stddev_pop("conf"), 6).alias("std"), F.min("conf").alias("least"), F.max("conf").alias("most"))


def vehicle_events(spark, sf):
    """Departures and arrivals: a vehicle that is there from the start of the clip leaves, one that stays to its end came."""
    t = tracklets(detections(spark, sf))
    c = t.groupBy("camera").agg(F.min("first_ts").alias("c0"), F.max("last_ts").alias("c1"))
    v = t.filter("entity_type = 'vehicle'").join(c, "camera").withColumn("edge", (F.col("c1") - F.col("c0")) * 0.05)
    start, end = F.col("first_ts") - F.col("c0") < F.col("edge"), F.col("c1") - F.col("last_ts") < F.col("edge")
    v = v.withColumn("event", F.when(start & ~end, "departure").when(~start & end, "arrival")).filter("event is not null")
    return v.select("camera", "track_id", "segment", "event", F.when(F.col("event") == "departure", F.col("last_ts")).otherwise(F.col("first_ts")).alias("event_ts"))


def track_ids(spark, sf):
    return iou_tracker(detections(spark, sf), 0.3, 60)


def concurrent_leaders(spark, sf):
    """Tracks of a camera and type that run beside each other at the same place, by the truncated mean box of each segment."""
    d = detections(spark, sf)
    box = gap_split(d, 360).groupBy("camera", "track_id", "segment").agg(*[(F.sum(c) / F.count(c)).cast("long").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    t = tracklets(d).drop("x1", "y1", "x2", "y2").join(box, ["camera", "track_id", "segment"]).withColumn("key", F.col("track_id") * 10000 + F.col("segment"))
    return absorb_concurrent(t, 0.25)


def gallery_leaders(spark, sf):
    return leader_dedup(gallery(spark, sf), "camera", ["vec_id"], "vec_id", "embedding", 0.47)


E = "first_ts - lag(last_ts) OVER (PARTITION BY track_id ORDER BY first_ts, segment)"
PLANS = {
    "gap_split": (gap_segments, f"WITH {D}, {T} SELECT event_id, camera, track_id, segment FROM s"),
    "tracklets": (tracklet_extents, f"WITH {D}, {T}, b AS (SELECT camera, track_id, segment, first(conf ORDER BY w * h DESC, event_id) AS conf, first(class_name ORDER BY w * h DESC, event_id) AS class_name FROM s GROUP BY ALL) SELECT t.*, b.conf, b.class_name FROM t JOIN b USING (camera, track_id, segment)"),
    "bbox_split": (bbox_split, f"""WITH {D}, f AS (SELECT camera, track_id, frame_idx, max(w * h) AS a FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER q AS i, count(*) OVER (PARTITION BY camera, track_id) AS n,
 list_sort(list(a) OVER (PARTITION BY camera, track_id ORDER BY frame_idx ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))[8] AS bef, list_sort(list(a) OVER (PARTITION BY camera, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))[8] AS aft
 FROM f WINDOW q AS (PARTITION BY camera, track_id ORDER BY frame_idx)) SELECT camera, track_id, min(frame_idx) AS split_frame FROM r WHERE i > 15 AND i <= n - 15 AND least(bef, aft) / greatest(bef, aft) < 0.5 GROUP BY ALL"""),
    "entity_extent": (entity_extent, f"WITH {D} SELECT camera, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM d GROUP BY ALL"),
    "best_crop": (best_crop, f"WITH {D} SELECT camera, track_id, first(event_id ORDER BY conf DESC, frame_idx, event_id) AS event_id, max(conf) AS conf FROM d WHERE w >= 20 AND h >= 30 GROUP BY ALL"),
    "median_rep": (median_rep, f"WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id) AS i, count(*) OVER (PARTITION BY camera, track_id) AS n FROM d) SELECT camera, track_id, event_id, frame_idx, n FROM r WHERE i = n // 2 + 1"),
    "color_vote": (color_vote, f"""WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY w * h DESC, event_id) AS i FROM d), c AS (SELECT camera, track_id, class_name, count(*) AS c, min(i) AS i FROM r WHERE i <= 5 AND class_name <> 'unknown' GROUP BY ALL)
 SELECT camera, track_id, first(class_name ORDER BY c DESC, i) AS class_name FROM c GROUP BY ALL"""),
    "mean_bbox": (mean_bbox, f"WITH {D} SELECT camera, track_id, " + ", ".join(f"trunc(sum({c}) / count(*))::BIGINT AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM d GROUP BY ALL"),
    "clip_bounds": (clip_bounds, f"WITH {D} SELECT camera, min(ts_sec) AS clip_start, greatest(0.0, max(ts_sec)) AS clip_end FROM d GROUP BY camera"),
    "top5_area": (top5_area, f"WITH {D}, r AS (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY w * h DESC, event_id)::INTEGER AS rank FROM d) SELECT camera, track_id, event_id, rank FROM r WHERE rank <= 5"),
    "timeline_gaps": (timeline_gaps, f"WITH {D}, {T}, x AS (SELECT *, {E} AS gap FROM t) SELECT camera, track_id, segment, round(gap, 6) AS gap FROM x WHERE gap > 0"),
    "onoff_summary": (onoff_summary, f"""WITH {D}, {T}, x AS (SELECT *, {E} AS gap FROM t) SELECT track_id, round(sum(last_ts - first_ts), 4) AS on_secs, round(sum(CASE WHEN gap > 0 THEN gap ELSE 0.0 END), 4) AS off_secs, count(*) FILTER (gap > 0) AS gaps, count(*) AS sightings,
 array_to_string(list_sort(list(DISTINCT camera)), ', ') AS cameras FROM x GROUP BY track_id"""),
    "pts_gaps": (pts_gaps, """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10000 AS pts FROM lineitem), x AS (SELECT *, lead(pts) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, pts) - pts AS step FROM p)
 SELECT l_orderkey, l_linenumber, round(step, 6) AS step, CASE WHEN step > 1 THEN 'critical' ELSE 'warning' END AS severity FROM x WHERE step > 0.15"""),
    "gop_cv": (gop_cv, f"""WITH {D}, l AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ts_sec, event_id) AS line FROM d), k AS (SELECT *, line - lag(line) OVER (PARTITION BY track_id ORDER BY ts_sec, event_id) AS gop FROM l WHERE class_name = 'click'),
 g AS (SELECT track_id, count(*) AS keys, stddev_pop(gop) / avg(gop) AS cv FROM k GROUP BY track_id HAVING count(*) >= 3) SELECT track_id, keys, round(cv, 6) AS cv, cv > 0.5 AS anomaly FROM g"""),
    "zscore_outliers": (zscore_outliers, "WITH z AS (SELECT event_id, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events) SELECT event_id, round(z, 5) AS z, round(least(z / 5, 1.0), 5) AS confidence FROM z WHERE z > 3"),
    "spread": (spread, f"WITH {D} SELECT camera, median(conf) AS median, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, min(conf) AS least, max(conf) AS most FROM d GROUP BY camera"),
    "vehicle_events": (vehicle_events, f"""WITH {D}, {T}, c AS (SELECT camera, min(first_ts) AS c0, max(last_ts) AS c1 FROM t GROUP BY camera), v AS (SELECT t.*, first_ts - c0 < (c1 - c0) * 0.05::DOUBLE AS a, c1 - last_ts < (c1 - c0) * 0.05::DOUBLE AS b FROM t JOIN c USING (camera) WHERE entity_type = 'vehicle')
 SELECT camera, track_id, segment, CASE WHEN a THEN 'departure' ELSE 'arrival' END AS event, CASE WHEN a THEN last_ts ELSE first_ts END AS event_ts FROM v WHERE a <> b"""),
    "iou_tracker": track_ids,
    "concurrent_dedup": concurrent_leaders,
    "leader_dedup": gallery_leaders,
}
