"""Order of detections within tracks: gaps, extents, representatives, size breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import area

ORDER = ("frame_idx", "event_id")


def gap_split(d: DataFrame, max_gap: float, fps: float = 1.0) -> DataFrame:
    """Append ``segment``, from 0 within a track: a new one starts where frames are further apart than ``max_gap`` seconds."""
    w = W.partitionBy("camera", "track_id").orderBy(*ORDER)
    gap = (F.col("frame_idx") - F.lag("frame_idx").over(w)) / fps > max_gap
    return d.withColumn("new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("segment", F.sum("new").over(w)).drop("new")


def tracklets(d: DataFrame, max_gap: float = 360) -> DataFrame:
    """Extents of the segments, with the largest box and a new id: the first segment keeps the track's, later ones follow the largest id."""
    s = gap_split(d, max_gap)
    best = F.max_by(F.struct("x1", "y1", "x2", "y2", "conf", "class_name"), F.struct(area(), -F.col("event_id")))
    t = s.groupBy("camera", "entity_type", "track_id", "segment").agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.min("ts_sec").alias("first_ts"), F.max("ts_sec").alias("last_ts"), F.count("*").alias("n"), best.alias("b")
    )
    return t.select("camera", "entity_type", "track_id", "segment", "first_frame", "last_frame", "first_ts", "last_ts", "n", "b.*")


TRACKLETS_SQL = """s AS (SELECT *, sum(new) OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id)::BIGINT AS segment FROM
 (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id) > 360 THEN 1 ELSE 0 END AS new FROM d)),
 t AS (SELECT camera, entity_type, track_id, segment, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, min(ts_sec) AS first_ts, max(ts_sec) AS last_ts, count(*) AS n,
  first(x1 ORDER BY w * h DESC, event_id) AS x1, first(y1 ORDER BY w * h DESC, event_id) AS y1, first(x2 ORDER BY w * h DESC, event_id) AS x2, first(y2 ORDER BY w * h DESC, event_id) AS y2
  FROM s GROUP BY ALL)"""


def size_break(d: DataFrame, ratio: float = 0.5, half: int = 15) -> DataFrame:
    """First frame of each track where the median box area of the ``half`` frames before and from there on differ by more than ``ratio``."""
    frames = d.groupBy("camera", "track_id", "frame_idx").agg(F.max(area()).alias("a"))
    w = W.partitionBy("camera", "track_id").orderBy("frame_idx")
    mid = lambda lo, hi: F.try_element_at(F.array_sort(F.collect_list("a").over(w.rowsBetween(lo, hi))), F.lit(half // 2 + 1))
    rows = frames.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("camera", "track_id")))
    rows = rows.withColumn("before", mid(-half, -1)).withColumn("after", mid(0, half - 1)).filter((F.col("i") > half) & (F.col("i") <= F.col("n") - half))
    hit = F.least("before", "after") / F.greatest("before", "after") < ratio
    return rows.filter(hit).groupBy("camera", "track_id").agg(F.min("frame_idx").alias("split_frame"))


def middle_detection(d: DataFrame) -> DataFrame:
    """The detection in the middle of each track."""
    w = W.partitionBy("camera", "track_id").orderBy(*ORDER)
    rows = d.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("camera", "track_id")))
    return rows.filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("camera", "track_id", "event_id", "frame_idx", "n")


def majority(d: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most frequent value of ``column`` in the ``top`` largest boxes of a track; of equals the one met first, unknown left out."""
    w = W.partitionBy("camera", "track_id").orderBy(area().desc(), "event_id")
    votes = d.withColumn("i", F.row_number().over(w)).filter((F.col("i") <= top) & (F.col(column) != "unknown"))
    votes = votes.groupBy("camera", "track_id", column).agg(F.count("*").alias("c"), F.min("i").alias("i"))
    return votes.groupBy("camera", "track_id").agg(F.max_by(column, F.struct("c", -F.col("i"))).alias(column))


def outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows whose ``column`` is more than ``limit`` standard deviations off the mean of all rows, with ``z`` and ``confidence``. Mean and deviation are one row, which is broadcast."""
    whole = df.agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__deviation"))
    z = F.try_divide(F.abs(F.col(column) - F.col("__mean")), F.col("__deviation"))
    return df.crossJoin(F.broadcast(whole)).withColumn("z", z).drop("__mean", "__deviation").filter(F.col("z") > limit).withColumn("confidence", F.least(F.col("z") / 5, F.lit(1.0)))


def split_at_break(d: DataFrame, ratio: float = 0.5, half: int = 15, step: int = 20_000) -> DataFrame:
    """Split tracks once, where ``size_break`` finds a break: from there on they get new ids, the camera's largest plus ``step`` and counted from 1 by track."""
    top = d.groupBy("camera").agg(F.max("track_id").alias("top"))
    k = F.row_number().over(W.partitionBy("camera").orderBy("track_id"))
    breaks = size_break(d, ratio, half).withColumn("k", k).join(top, "camera").select("camera", "track_id", "split_frame", (F.col("top") + step + F.col("k")).alias("fresh"))
    new = F.when(F.col("frame_idx") >= F.col("split_frame"), F.col("fresh")).otherwise(F.col("track_id"))
    return d.join(breaks, ["camera", "track_id"], "left").withColumn("track_id", new).drop("split_frame", "fresh")


def timeline(sightings: DataFrame, identity: str) -> DataFrame:
    """Rows of each identity's time line: ``on`` for a sighting, ``off`` for the time to the next one on the same camera and ``transit`` on another, where there is any."""
    w = W.partitionBy(identity).orderBy("first_ts", "last_ts", "camera")
    s = sightings.withColumn("was", F.lag("camera").over(w)).withColumn("until", F.lag("last_ts").over(w))
    on = F.struct(F.lit("on").alias("kind"), F.col("camera").alias("place"), F.col("first_ts").alias("begin"), F.col("last_ts").alias("finish"))
    gap = F.struct(F.when(F.col("was") == F.col("camera"), "off").otherwise("transit").alias("kind"), F.when(F.col("was") == F.col("camera"), F.col("camera")).otherwise(F.concat_ws(" > ", "was", "camera")).alias("place"), F.col("until").alias("begin"), F.col("first_ts").alias("finish"))
    return s.select(identity, F.inline(F.array(on, gap))).filter("kind = 'on' or finish > begin").withColumn("lasts", F.col("finish") - F.col("begin"))
