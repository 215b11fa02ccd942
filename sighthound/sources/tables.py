"""Readers of the domain tables, and the domain tables that the driver's tables stand for."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPORT = """sha256 string, source_path string, model_path string, confidence_threshold double, frame_stride int, device string, imgsz int,
metadata struct<metadata_backend: string, duration_seconds: double, size_bytes: bigint, bit_rate: bigint, codec: string, width: int, height: int, frame_rate: double, frame_count: bigint, creation_time: string>,
detections array<struct<frame_index: bigint, timestamp_seconds: double, detections: array<struct<class_id: int, class_name: string, confidence: double, bbox_xyxy: array<double>>>,
motion: struct<has_motion: boolean, motion_percentage: double, motion_area_pixels: bigint, num_moving_objects: int>>>"""


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Detection reports, one JSON document a file; unreadable ones are left out. A report without sha256 is an error when it is used."""
    df = spark.read.schema(REPORT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("sha256", F.coalesce("sha256", F.raise_error(F.lit("a report has no sha256")).cast("string")))


def report_frames(reports: DataFrame) -> DataFrame:
    """One row per frame, with its position."""
    df = reports.select("sha256", F.posexplode_outer("detections").alias("frame_pos", "frame"))
    return df.select("sha256", "frame_pos", "frame.frame_index", "frame.timestamp_seconds", F.coalesce(F.size("frame.detections"), F.lit(0)).alias("detections_count"), F.col("frame.detections").alias("boxes"))


def report_detections(reports: DataFrame) -> DataFrame:
    """One row per box, with frame and box positions; coordinates that are missing are null."""
    df = report_frames(reports).select("*", F.posexplode("boxes").alias("box_pos", "box"))
    xy = [F.get("box.bbox_xyxy", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return df.select("sha256", "frame_pos", "frame_index", "timestamp_seconds", "box_pos", "box.class_id", "box.class_name", "box.confidence", *xy)


def numbered_lines(spark: SparkSession, path: str, on: bool = False) -> DataFrame:
    """Lines ``(path, ord, line)`` of text files, counted from 0 within a file, with ``on`` over all files by name.

    Each input split is a partition with its place in the file, so a running count within it and the sum of the splits
    before it give the number; no task holds a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    counts = lines.groupBy("path", "at").agg(F.count("*").alias("c"), F.min("id").alias("low"))
    before = F.sum("c").over(W.orderBy("path", "at") if on else W.partitionBy("path").orderBy("at")) - F.col("c")  # one row per split
    starts = counts.select("path", "at", (before - F.col("low")).alias("shift"))
    return lines.join(F.broadcast(starts), ["path", "at"]).select("path", (F.col("id") + F.col("shift")).alias("ord"), F.col("value").alias("line"))


def read_packets(spark: SparkSession, path: str, on: bool = False) -> DataFrame:
    """Packet lines ``pts,duration,flags``: the line's number (``on``: over all files) stays, lines that are blank or too short go, N/A is null."""
    part = F.split("line", ",")
    lines = numbered_lines(spark, path, on).filter((F.trim("line") != "") & (F.size(part) >= 3))
    return lines.select("ord", F.get(part, F.lit(0)).try_cast("double").alias("pts"), F.get(part, F.lit(1)).try_cast("double").alias("duration"), F.contains(F.get(part, F.lit(2)), F.lit("K")).alias("key_frame"))


def file_hashes(spark: SparkSession, path: str, piece: int = 1 << 20) -> DataFrame:
    """Files with size and SHA-256, of any length: paths are listed, and a task reads its files ``piece`` bytes at a time.

    Empty files are left out, as Spark's listing does. Tasks open files as Arrow's file systems do (local paths and the schemes that these know); a file is read once.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))

    def run(batches):
        import hashlib

        from pyarrow import fs

        for batch in batches:
            made = []
            for uri in batch["path"].to_pylist():
                system, place = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
                digest = hashlib.sha256()
                with system.open_input_stream(place) as f:
                    while block := f.read(piece):
                        digest.update(block)
                made.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["size_bytes"], pa.array(made, pa.string())], ["path", "size_bytes", "sha256"])

    return files.mapInArrow(run, "path string, size_bytes long, sha256 string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections from ``events``: one frame a minute since 2024-01-01, four cameras, a track per user."""
    e = table(spark, sf_dir, "events")
    d = e.withColumn("ts_sec", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6D"))
    late = F.expr("user_id % 5 = 0 and ts >= timestamp_ntz'2024-01-16 00:00:00'")
    d = d.select(
        "event_id", "ts_sec", F.floor(F.col("ts_sec") / 60).alias("frame_idx"), F.concat(F.lit("cam"), (F.col("user_id") % 4).cast("string")).alias("camera"),
        F.col("user_id").alias("track_id"), F.col("event_type").alias("class_name"), F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"),
        F.expr("cast((user_id * 37) % 600 + event_id % 7 as double)").alias("x1"), F.expr("cast((user_id * 53) % 400 + event_id % 5 as double)").alias("y1"),
        (F.expr("cast(20 + (user_id * 17) % 180 as double)") + F.when(late, 120.0).otherwise(0.0)).alias("w"), F.expr("cast(20 + (user_id * 29) % 180 as double)").alias("h"),
    )
    kind = F.when(F.col("track_id") % 3 == 0, "vehicle").otherwise("person")
    return d.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("h")).withColumn("entity_type", kind)


DETECTIONS_SQL = """d AS (SELECT *, x1 + w AS x2, y1 + h AS y2, CASE WHEN track_id % 3 = 0 THEN 'vehicle' ELSE 'person' END AS entity_type FROM (SELECT event_id,
 (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS ts_sec, floor((epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE / 60)::BIGINT AS frame_idx, 'cam' || (user_id % 4) AS camera,
 user_id AS track_id, event_type AS class_name, least(value / 100, 1.0) AS conf, ((user_id * 37) % 600 + event_id % 7)::DOUBLE AS x1, ((user_id * 53) % 400 + event_id % 5)::DOUBLE AS y1,
 (20 + (user_id * 17) % 180)::DOUBLE + CASE WHEN user_id % 5 = 0 AND ts >= TIMESTAMP '2024-01-16' THEN 120.0 ELSE 0.0 END::DOUBLE AS w, (20 + (user_id * 29) % 180)::DOUBLE AS h FROM events))"""


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance vectors from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("cam"), (F.col("vec_id") % 4).cast("string")).alias("camera"), F.when(F.col("label") < 7, "person").otherwise("vehicle").alias("entity_type"), "embedding")


GALLERY_SQL = "g AS (SELECT vec_id, 'cam' || (vec_id % 4) AS camera, CASE WHEN label < 7 THEN 'person' ELSE 'vehicle' END AS entity_type, embedding::DOUBLE[] AS v FROM embeddings)"
