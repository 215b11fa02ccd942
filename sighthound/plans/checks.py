"""Motion, time stamps, metadata and lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.colour import clothing_cluster, hair_colour, vehicle_cluster
from ..functions.text import away_text, frame_rate, gap_text, moment, overlay_time, rounded
from ..functions.video import auto_stride, metadata_flags, motion, padded
from ..operators.tracks import gap_split
from ..sources.store import recorder_slots
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import detections, table


def overlay_timestamp(spark, sf):
    """Times read back from order dates written the way a recorder's overlay is misread."""
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    noisy = F.concat(F.lit("CAM 1 "), F.regexp_replace("day", "-", "_"), F.lit(",12 : 30:05 x"))
    return o.select("o_orderkey", overlay_time(noisy).alias("at"))


def framerate_parse(spark, sf):
    return table(spark, sf, "part").select("p_partkey", rounded(frame_rate(F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 3).cast("string"))), 6).alias("fps"))


def metadata_checks(spark, sf):
    """Declared against found length, rate and frames, one row per flag."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("secs"), F.expr("cast(p_size * 250 + p_partkey % 11 * 20 as bigint)").alias("frames"), F.expr("cast(p_size * 1000 + p_partkey % 7 * 900 as double)").alias("size"))
    f = metadata_flags(F.col("secs"), F.col("frames"), F.lit(25.0), F.col("size"), F.lit(800.0), (F.col("secs") * 25).cast("long"))
    return p.select("p_partkey", F.inline(f)).select("p_partkey", "check", "severity", rounded("confidence", 6).alias("confidence"))


def quality_drops(spark, sf):
    """Values far below their class's mean and below a half."""
    w = W.partitionBy("class_name")
    d = detections(spark, sf).withColumn("q", rounded(F.col("conf"), 4))
    least = F.greatest(F.avg("conf").over(w) - 3 * F.stddev_pop("conf").over(w), F.lit(0.3))
    d = d.withColumn("least", least).filter((F.col("q") < F.col("least")) & (F.col("q") < 0.5))
    return d.select("event_id", F.when(F.col("q") < 0.2, "critical").otherwise("warning").alias("severity"), rounded(1 - F.col("q"), 4).alias("confidence"))


def nearest_frame(spark, sf):
    """The detection of each track that is nearest to noon of the tenth day."""
    at = 9 * 86400.0 + 43200
    return detections(spark, sf).groupBy("camera", "track_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("ts_sec") - at), "event_id")).alias("event_id"), rounded(F.min(F.abs(F.col("ts_sec") - at)), 6).alias("off"))


def motion_join(spark, sf):
    """Frames with the motion last reported for them, none reported meaning none seen."""
    d = detections(spark, sf)
    frames = d.groupBy("camera", "frame_idx").agg(F.count("*").alias("n"))
    areas = F.array(F.col("w") * F.col("h"), F.col("w") * 3, F.col("h") * 9)
    seen = d.filter("class_name = 'click'").select("camera", "frame_idx", "event_id", motion(areas, F.lit(250000)).alias("m"))
    last = seen.groupBy("camera", "frame_idx").agg(F.max_by("m", "event_id").alias("m"))
    return frames.join(last, ["camera", "frame_idx"], "left").select("camera", "frame_idx", "n", F.coalesce("m.has_motion", F.lit(False)).alias("has_motion"), F.coalesce("m.motion_area_pixels", F.lit(0)).alias("pixels"), F.coalesce(F.col("m.num_moving_objects").cast("long"), F.lit(0)).alias("objects"))


def tracks_with_points(spark, sf):
    """Tracks with their points in order of time; all customers are tracks here, those without orders have none."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    p = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("points"))
    t = c.join(p, c.c_custkey == p.o_custkey, "left")
    return t.select("c_custkey", F.coalesce(F.size("points"), F.lit(0)).cast("long").alias("n"), F.get("points", F.lit(0))["o_orderkey"].alias("first_point"))


def frame_overlay(spark, sf):
    """Boxes to draw on each frame, in their crops' margins."""
    d = detections(spark, sf).withColumn("crop", F.array(*padded([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640.0), F.lit(480.0), 10)))
    return d.select("camera", "frame_idx", "event_id", *[F.get("crop", F.lit(i)).alias(f"c{i}") for i in range(4)])


def _clusters(d):
    part = lambda a, b, c, f: F.struct(F.expr(f"(event_id * {a}) % 180").alias("h"), F.expr(f"(event_id * {b}) % 256").alias("s"), F.expr(f"(event_id * {c}) % 256").alias("v"), F.lit(f).alias("fraction"))
    return d.withColumn("clusters", F.array(part(7, 13, 29, 0.5), part(11, 17, 31, 0.3), part(19, 23, 37, 0.17), part(41, 43, 47, 0.03)))


def colour_picks(spark, sf):
    """Which of each detection's four colour clusters stands for clothing, paint and hair."""
    d = _clusters(table(spark, sf, "events").select("event_id"))
    return d.select("event_id", clothing_cluster(F.col("clusters"))["fraction"].alias("clothing"), vehicle_cluster(F.col("clusters"))["fraction"].alias("paint"), hair_colour(F.col("clusters")).alias("hair"))


def strides(spark, sf):
    return table(spark, sf, "part").select("p_partkey", auto_stride((F.col("p_partkey") * F.col("p_size") * 37).cast("long"), F.col("p_size").cast("double")).alias("stride"))


def time_texts(spark, sf):
    d = detections(spark, sf).withColumn("t", rounded(F.col("ts_sec") / 100, 2))
    return d.select("event_id", gap_text(F.col("t")).alias("gap"), away_text(F.col("t")).alias("away"), F.date_format(moment(F.lit("2024-03-01"), F.lit("08:00:00"), F.floor("ts_sec")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def slots(spark, sf):
    """Minutes of a recorder's day with the detections of each."""
    d = detections(spark, sf).withColumn("m", F.floor(F.col("ts_sec") / 60) % 1440)
    n = d.select(F.concat_ws(":", F.lpad(F.floor(F.col("m") / 60).cast("string"), 2, "0"), F.lpad((F.col("m") % 60).cast("string"), 2, "0")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    return recorder_slots(spark, (7, 45), (19, 10)).join(n, "slot", "left").select("slot", "path", F.coalesce("n", F.lit(0)).alias("n"))


def noise_gate(spark, sf):
    """Segments with two detections at least; of vehicles the whole track needs two before the split as well."""
    d = detections(spark, sf)
    many = F.count("*").over(W.partitionBy("camera", "track_id")) >= 2
    s = gap_split(d.withColumn("many", many).filter((F.col("entity_type") == "person") | F.col("many")), 360)
    return s.groupBy("camera", "entity_type", "track_id", "segment").agg(F.count("*").alias("n")).filter("n >= 2")


PLANS = {
    "overlay_timestamp": (overlay_timestamp, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 12:30:05' AS at FROM orders"),
    "framerate_parse": (framerate_parse, "SELECT p_partkey, round(p_size / nullif(p_partkey % 3, 0)::DOUBLE, 6) AS fps FROM part"),
    "metadata_checks": (metadata_checks, """WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS secs, p_size * 250 + p_partkey % 11 * 20 AS frames, (p_size * 1000 + p_partkey % 7 * 900)::DOUBLE AS size FROM part), q AS (SELECT *, abs(secs - frames / 25.0::DOUBLE) AS off, abs(size * 8 / secs - 800) / 800 AS rate, abs(secs * 25 - frames) AS miss FROM p)
 SELECT p_partkey, 'duration' AS check, 'warning' AS severity, round(least(off / secs, 1.0), 6) AS confidence FROM q WHERE off > greatest(secs * 0.02::DOUBLE, 1.0) UNION ALL
 SELECT p_partkey, 'bit_rate', 'info', round(least(rate, 1.0), 6) FROM q WHERE rate > 0.15::DOUBLE UNION ALL SELECT p_partkey, 'frames', 'warning', round(least(miss / frames, 1.0), 6) FROM q WHERE miss > greatest(frames * 0.01::DOUBLE, 5)"""),
    "quality_drops": (quality_drops, f"WITH {D}, q AS (SELECT event_id, round(conf, 4) AS q, greatest(avg(conf) OVER (PARTITION BY class_name) - 3 * stddev_pop(conf) OVER (PARTITION BY class_name), 0.3) AS lo FROM d) SELECT event_id, CASE WHEN q < 0.2 THEN 'critical' ELSE 'warning' END AS severity, round(1 - q, 4) AS confidence FROM q WHERE q < lo AND q < 0.5"),
    "nearest_frame": (nearest_frame, f"WITH {D} SELECT camera, track_id, first(event_id ORDER BY abs(ts_sec - 820800), event_id) AS event_id, round(min(abs(ts_sec - 820800)), 6) AS off FROM d GROUP BY ALL"),
    "motion_join": (motion_join, f"""WITH {D}, f AS (SELECT camera, frame_idx, count(*) AS n FROM d GROUP BY ALL), m AS (SELECT camera, frame_idx, [w * h, w * 3, h * 9] AS a FROM d WHERE class_name = 'click' QUALIFY row_number() OVER (PARTITION BY camera, frame_idx ORDER BY event_id DESC) = 1),
 x AS (SELECT camera, frame_idx, list_filter(a, lambda v: v >= 500) AS a FROM m), y AS (SELECT camera, frame_idx, coalesce(list_sum(a), 0) AS area, len(a) AS objects FROM x)
 SELECT camera, frame_idx, n, coalesce(area / 250000 >= 0.02, false) AS has_motion, coalesce(trunc(area)::BIGINT, 0) AS pixels, coalesce(objects, 0) AS objects FROM f LEFT JOIN y USING (camera, frame_idx)"""),
    "tracks_with_points": (tracks_with_points, "SELECT c_custkey, count(o_orderkey) AS n, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_point FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "frame_overlay": (frame_overlay, f"WITH {D} SELECT camera, frame_idx, event_id, greatest(x1 - 10, 0) AS c0, greatest(y1 - 10, 0) AS c1, least(x2 + 10, 640) AS c2, least(y2 + 10, 480) AS c3 FROM d"),
    "colour_picks": colour_picks,
    "auto_stride": (strides, "WITH p AS (SELECT p_partkey, p_partkey * p_size * 37 AS n, p_size FROM part) SELECT p_partkey, CASE WHEN n <= 135000 THEN 1 ELSE greatest(least(n // 135000, greatest(p_size, 1)), 1) END::BIGINT AS stride FROM p"),
    "time_texts": (time_texts, f"""WITH {D}, x AS (SELECT event_id, round(ts_sec / 100, 2) AS t, floor(ts_sec)::BIGINT AS s FROM d), y AS (SELECT *, floor(t)::BIGINT AS f FROM x)
 SELECT event_id, CASE WHEN t < 60 THEN round_even(t, 0)::BIGINT || 's' ELSE printf('%.1f', round_even(t / 60, 1)) || 'm' END AS gap, CASE WHEN t < 60 THEN round_even(t, 0)::BIGINT || 's' WHEN t < 3600 THEN round_even(t / 60, 0)::BIGINT || 'min' ELSE (f // 3600) || 'h ' || (f % 3600 // 60) || 'm' END AS away,
 strftime(TIMESTAMP '2024-03-01 08:00:00' + to_seconds(s), '%Y-%m-%d %H:%M:%S') AS at FROM y"""),
    "recorder_slots": (slots, f"""WITH {D}, n AS (SELECT floor(ts_sec / 60)::BIGINT % 1440 AS m, count(*) AS n FROM d GROUP BY 1), s AS (SELECT unnest(range(465, 1151)) AS m)
 SELECT lpad((m // 60)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS slot, lpad((m // 60)::VARCHAR, 2, '0') || '/' || lpad((m % 60)::VARCHAR, 2, '0') || '.mp4' AS path, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (m)"""),
    "noise_gate": (noise_gate, f"WITH {D}, s AS (SELECT *, sum(new) OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id)::BIGINT AS segment FROM (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id) > 360 THEN 1 ELSE 0 END AS new FROM d)) SELECT camera, entity_type, track_id, segment, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 2"),
}
