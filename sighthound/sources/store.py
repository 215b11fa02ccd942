"""Stored tables: upsert, replace, append and delete; manifests; recorder segments.

A table is a Parquet folder in ``PARTS`` parts by a hash of its key. A change rewrites only the parts of its keys, so its
cost follows what it touches; one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import durable
from .tables import REPORT, report_detections, report_frames

PARTS = 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def replace(path: str, key: str, rows: DataFrame | None, keys: DataFrame) -> None:
    """Put ``rows`` in place of all stored rows whose ``key`` is in ``keys``; without ``rows`` these are deleted."""
    spark = keys.sparkSession
    keys = durable(keys.select(key).distinct())
    out = None if rows is None else rows.withColumn("part", _part(key))
    touched = [r[0] for r in keys.select(_part(key)).distinct().collect()]  # PARTS numbers at most
    if not touched:
        return
    if exists(spark, path):
        kept = spark.read.parquet(path).filter(F.col("part").isin(touched)).join(keys, key, "left_anti")
        out = kept if out is None else kept.unionByName(out, allowMissingColumns=True)
    if out is None:
        return
    out = durable(out)
    left = {r[0] for r in out.select("part").distinct().collect()}
    out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    for part in set(touched) - left:
        fs, p = _folder(spark, f"{path}/part={part}")
        if fs.exists(p):
            fs.delete(p, True)


def append(path: str, key: str, rows: DataFrame) -> None:
    rows.withColumn("part", _part(key)).write.mode("append").partitionBy("part").parquet(path)


class Store:
    """Videos, frames, detections, tracks and points under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return read(self.spark, f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.path}/{name}")

    def import_reports(self, reports: DataFrame) -> DataFrame:
        """Store reports; a video that is known keeps its ``created_at``, its frames and detections are replaced, its tracks stay. Returns counts by video.

        Of several reports of one video the one with the last path counts.
        """
        reports = durable(reports.withColumn("n", F.struct("source_path", F.xxhash64(F.to_json("metadata")))).groupBy("sha256").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "sha256"]), "n").alias("r")).select("sha256", "r.*"))
        keys = reports.select("sha256")
        videos = reports.drop("detections").withColumn("created_at", F.current_timestamp())
        if self.has("videos"):
            known = self.table("videos").select("sha256", F.col("created_at").alias("was"))
            videos = videos.join(known, "sha256", "left").withColumn("created_at", F.coalesce("was", "created_at")).drop("was")
        frames = report_frames(reports).drop("boxes")
        replace(f"{self.path}/videos", "sha256", videos, keys)
        replace(f"{self.path}/frames", "sha256", frames, keys)
        replace(f"{self.path}/detections", "sha256", report_detections(reports), keys)
        return keys.join(frames.groupBy("sha256").agg(F.count("*").alias("frames_imported"), F.sum("detections_count").alias("detections_imported")), "sha256", "left").fillna(0)

    def store_tracks(self, sha256: str, tracks: DataFrame) -> None:
        """Replace the tracks ``(track_id, class_name, start_frame, end_frame, start_time, end_time, points)`` of a video, which must be known."""
        self.replace_tracks(self.spark.createDataFrame([(sha256,)], "sha256 string"), tracks.withColumn("sha256", F.lit(sha256)))

    def replace_tracks(self, keys: DataFrame, tracks: DataFrame) -> None:
        """Replace the tracks of all videos ``keys(sha256)``, which must be known, by ``tracks``, which name their video."""
        unknown = keys if not self.has("videos") else keys.join(self.table("videos").select("sha256"), "sha256", "left_anti")
        if first := unknown.first():
            raise ValueError(f"no video {first['sha256']} is stored")
        replace(f"{self.path}/tracks", "sha256", tracks, keys)

    def query_detections(self, sha256: str, class_name: str | None = None, min_conf: float = 0.0, time_range: tuple[float | None, float | None] | None = None) -> DataFrame:
        """Detections of a video by class, least confidence and inclusive times, by time."""
        d = self.table("detections").filter((F.col("sha256") == sha256) & (F.col("confidence") >= min_conf))
        if class_name:
            d = d.filter(F.col("class_name") == class_name)
        for bound, test in zip(time_range or (None, None), ("__ge__", "__le__"), strict=True):
            if bound is not None:
                d = d.filter(getattr(F.col("timestamp_seconds"), test)(bound))
        return d.select("frame_index", "timestamp_seconds", "class_id", "class_name", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy")).orderBy("timestamp_seconds", "frame_index")

    def query_tracks(self, sha256: str, class_name: str | None = None) -> DataFrame:
        """Tracks of a video by start; points by time, none an empty list."""
        t = self.table("tracks").filter(F.col("sha256") == sha256)
        t = t if not class_name else t.filter(F.col("class_name") == class_name)
        return t.withColumn("points", F.coalesce(F.array_sort("points"), F.array())).withColumn("label", F.concat(F.lit("track-"), F.col("track_id").cast("string"))).orderBy("start_time", "track_id")

    def append_entities(self, entities: DataFrame) -> None:
        append(f"{self.path}/entities", "camera", entities)

    def append_history(self, frames: DataFrame) -> None:
        """Add frames ``(entity_id, camera, frame_idx, ...)`` in which entities were seen."""
        append(f"{self.path}/history", "camera", frames)

    def delete_camera(self, camera: str) -> None:
        """Delete a camera's entities and their history, before it is processed again."""
        for name in ("entities", "history"):
            if self.has(name):
                replace(f"{self.path}/{name}", "camera", None, self.spark.createDataFrame([(camera,)], "camera string"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines in a folder per hash."""
    reports.withColumn("key", F.col("sha256")).repartition("key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").json(path)


def read_written_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


MANIFEST = "array<struct<source_path: string, sha256: string, size_bytes: bigint, ingested_at: string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON list in order (``ord``); a file that holds anything else is an error when it is used."""
    text = spark.read.text(path, wholetext=True)
    right = F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", MANIFEST))
    entries = F.coalesce(right, F.raise_error(F.lit("a manifest must be a JSON list")).cast(MANIFEST))
    return text.select(F.posexplode(entries).alias("ord", "e")).select("ord", "e.*")


def append_manifest(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Add ``entries`` to a manifest, a JSON list in one file, which is made where there is none. The old file stays until the new one is whole.

    A manifest has one entry per recording and is written as one value, as its readers want it.
    """
    fields = [f.strip().split(":")[0] for f in MANIFEST[len("array<struct<") : -2].split(",")]
    new = entries.select(*fields).withColumn("ord", F.monotonically_increasing_id() + (1 << 40))
    if exists(spark, path):
        new = read_manifest(spark, path).select("ord", *fields).unionByName(new)
    rows = new.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ord", *fields))), lambda e: F.struct(*[e[c].alias(c) for c in fields]))).alias("value"))
    fs, place = _folder(spark, path)
    made = _folder(spark, f"{path}.new")[1]
    rows.coalesce(1).write.mode("overwrite").text(f"{path}.new")
    (part,) = [s.getPath() for s in fs.listStatus(made) if s.getPath().getName().startswith("part-")]
    fs.delete(place, True)
    fs.rename(part, place)
    fs.delete(made, True)


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """MATCH, MISMATCH or NOT_FOUND for files ``(path, sha256)`` by path or hash, the first entry counting."""
    m = manifest.select("ord", F.col("source_path").alias("m_path"), F.col("sha256").alias("m_sha"))
    hits = files.join(m, F.col("path") == F.col("m_path")).unionByName(files.join(m, F.col("sha256") == F.col("m_sha")))
    first = hits.groupBy("path").agg(F.min_by("m_sha", "ord").alias("stored_sha256"))
    state = F.when(F.col("stored_sha256").isNull(), "NOT_FOUND").when(F.col("stored_sha256") == F.col("sha256"), "MATCH").otherwise("MISMATCH")
    return files.join(first, "path", "left").withColumn("state", state)


def recorder_slots(spark: SparkSession, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Minutes ``(slot, path)`` of a recorder's folder from ``start`` to ``end``, both included: the start's minute trims the first hour only, the end's the last."""
    m = spark.range(60 * start[0], 60 * (end[0] + 1)).select((F.col("id") / 60).cast("int").alias("hour"), (F.col("id") % 60).cast("int").alias("minute"))
    m = m.filter(~((F.col("hour") == start[0]) & (F.col("minute") < start[1])) & ~((F.col("hour") == end[0]) & (F.col("minute") > end[1])))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return m.select(F.concat_ws(":", two("hour"), two("minute")).alias("slot"), F.concat(two("hour"), F.lit("/"), two("minute"), F.lit(".mp4")).alias("path"))


def recorder_segments(slots: DataFrame, listing: DataFrame) -> DataFrame:
    """``(slot, path, state)`` of each minute against a listing ``(path, readable)``: ok, missing or unreadable."""
    state = F.when(F.col("readable").isNull(), "missing").when(F.col("readable"), "ok").otherwise("unreadable")
    return slots.join(listing.groupBy("path").agg(F.bool_or("readable").alias("readable")), "path", "left").select("slot", "path", state.alias("state"))
