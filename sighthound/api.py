"""The library's front: what the command line and services call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import identities as I
from .operators.durable import durable
from .operators.evaluation import evaluation, system_tracks
from .operators.stateful import iou_tracker
from .sources.store import Store, read_manifest, verify, write_reports
from .sources.tables import file_hashes, read_reports, report_detections, report_frames
from .sources.truth import read_truth, template, truth_cameras


def summarize(reports: DataFrame) -> DataFrame:
    """One row per report: frames, frames with detections, detections, bounds of time over all frames, and statistics by class."""
    frames = report_frames(reports).groupBy("sha256").agg(
        F.count("frame_pos").alias("frames_in_report"), F.count_if(F.col("detections_count") > 0).alias("frames_with_detections"), F.sum("detections_count").alias("detections_total"), F.min("timestamp_seconds").alias("start_seconds"), F.max("timestamp_seconds").alias("end_seconds")
    )
    at = F.struct("frame_index", "frame_pos", "box_pos")
    late = F.struct("frame_index", -F.col("frame_pos"), -F.col("box_pos"))
    d = report_detections(reports).withColumn("name", F.coalesce(F.nullif("class_name", F.lit("")), F.col("class_id").cast("string"), F.lit("None")))
    numbered = F.col("frame_index").isNotNull()
    d = d.groupBy("sha256", "name").agg(
        F.count("*").alias("count"), F.min_by("frame_index", F.when(numbered, at)).alias("first_seen_frame"), F.min_by("timestamp_seconds", F.when(numbered, at)).alias("first_seen_time"), F.max_by("frame_index", F.when(numbered, late)).alias("last_seen_frame"), F.max_by("timestamp_seconds", F.when(numbered, late)).alias("last_seen_time")
    )
    classes = d.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("name", "count", "first_seen_frame", "first_seen_time", "last_seen_frame", "last_seen_time"))).alias("classes"))
    return reports.select("sha256", "source_path", "model_path").join(frames, "sha256", "left").join(classes, "sha256", "left").withColumn("classes", F.coalesce("classes", F.array()))


def summary_text(summaries: DataFrame) -> DataFrame:
    """``(sha256, text)``: the summary in lines, classes by name."""
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    seen = lambda c: F.when(c["first_seen_time"].isNotNull() & c["last_seen_time"].isNotNull(), F.concat(F.lit(" (first @ "), two(c["first_seen_time"]), F.lit("s, last @ "), two(c["last_seen_time"]), F.lit("s)"))).otherwise("")
    lines = F.transform("classes", lambda c: F.concat(F.lit("  - "), c["name"], F.lit(": "), c["count"].cast("string"), F.lit(" detections"), seen(c)))
    span = F.when(F.col("start_seconds").isNotNull() & F.col("end_seconds").isNotNull(), F.concat(F.lit("Time span covered: "), two(F.col("start_seconds")), F.lit("s – "), two(F.col("end_seconds")), F.lit("s")))
    head = [
        F.concat(F.lit("Source: "), put("source_path")), F.concat(F.lit("SHA-256: "), put("sha256")), F.concat(F.lit("Model: "), put("model_path")),
        F.concat(F.lit("Frames analyzed: "), put("frames_in_report"), F.lit(" (with detections: "), put("frames_with_detections"), F.lit(")")), F.concat(F.lit("Total detections: "), put("detections_total")), span, F.lit("Per-class stats:"),
    ]
    body = F.when(F.size("classes") > 0, lines).otherwise(F.array(F.lit("  (no detections)")))
    return summaries.select("sha256", F.concat_ws("\n", *head, F.array_join(body, "\n")).alias("text"))


def track_reports(reports: DataFrame, least_iou: float = 0.3, max_gap: int = 2) -> DataFrame:
    """Tracks of reports, one row each with its points; detections are taken by frame and position, a frame without a number as frame 0."""
    d = report_detections(reports).select(
        F.col("sha256").alias("camera"), F.coalesce("class_name", F.lit("")).alias("class_name"), F.coalesce("frame_index", F.lit(0)).alias("frame_idx"), (F.col("frame_pos").cast("long") * 1000000 + F.col("box_pos")).alias("event_id"), "x1", "y1", "x2", "y2", "timestamp_seconds", "confidence"
    ).dropna(subset=["x1", "y1", "x2", "y2"])
    point = F.struct(F.col("frame_idx").alias("frame_index"), "event_id", "timestamp_seconds", "confidence", F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"))
    t = iou_tracker(d, least_iou, max_gap).join(d, ["camera", "event_id"]).groupBy(F.col("camera").alias("sha256"), F.col("track_no").cast("int").alias("track_id")).agg(F.first("class_name").alias("class_name"), F.array_sort(F.collect_list(point)).alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    points = F.transform("p", lambda x: F.struct(x["timestamp_seconds"].alias("timestamp_seconds"), x["frame_index"].alias("frame_index"), x["confidence"].alias("confidence"), x["bbox_xyxy"].alias("bbox_xyxy")))
    return t.select("sha256", "track_id", "class_name", first["frame_index"].alias("start_frame"), last["frame_index"].alias("end_frame"), first["timestamp_seconds"].alias("start_time"), last["timestamp_seconds"].alias("end_time"), points.alias("points"))


class Engine:
    """Hashes, reports, tracks and queries over one store."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, Store(spark, store)

    def hash(self, path: str) -> DataFrame:
        return file_hashes(self.spark, path)

    def verify(self, path: str, manifest: str) -> DataFrame:
        return verify(file_hashes(self.spark, path), read_manifest(self.spark, manifest))

    def analyze(self, path: str) -> DataFrame:
        return summary_text(summarize(read_reports(self.spark, path)))

    def import_reports(self, path: str) -> DataFrame:
        return self.store.import_reports(read_reports(self.spark, path))

    def track(self, path: str, least_iou: float = 0.3, max_gap: int = 2, keep: bool = False) -> DataFrame:
        tracks = track_reports(read_reports(self.spark, path), least_iou, max_gap)
        if keep:
            tracks = durable(tracks)
            self.store.replace_tracks(read_reports(self.spark, path).select("sha256"), tracks)
        return tracks

    def query(self, sha256: str, class_name: str | None = None, min_conf: float = 0.0, start: float | None = None, end: float | None = None) -> DataFrame:
        return self.store.query_detections(sha256, class_name, min_conf, (start, end))

    def tracks(self, sha256: str, class_name: str | None = None) -> DataFrame:
        return self.store.query_tracks(sha256, class_name)

    def identify(self, cameras: list[str] | None = None, limits: I.Limits = I.Limits()) -> DataFrame:
        """``(entity_id, entity_type, root)`` of the stored entities of some cameras, or all; every two cameras are matched."""
        e = self.store.table("entities")
        e = I.durable(e.filter(F.col("camera").isin(cameras)) if cameras else e)
        return I.identities(e, I.durable(I.match_all(e, limits)), limits)

    def evaluate(self, truth: str, least: float = 0.3) -> DataFrame:
        """Scores of the stored entities against a file of true appearances, which may narrow the cameras."""
        cameras = truth_cameras(self.spark, truth)
        system = I.durable(system_tracks(self.store.table("entities"), self.store.table("history"), cameras))
        members = self.identify(cameras).join(system.select("entity_id", "camera", "sys_id"), "entity_id")
        return evaluation(read_truth(self.spark, truth), system.drop("entity_id"), members.select("entity_type", F.col("root").alias("identity"), "camera", "sys_id"), least)

    def reports(self) -> DataFrame:
        """Videos of the store with the numbers of their frames and detections."""
        n = self.store.table("frames").groupBy("sha256").agg(F.count("*").alias("frames"), F.sum("detections_count").alias("detections"))
        return self.store.table("videos").join(n, "sha256", "left").select("sha256", "source_path", "frames", "detections").orderBy("sha256")


__all__ = ["Engine", "Store", "read_reports", "read_truth", "summarize", "summary_text", "template", "track_reports", "write_reports"]
