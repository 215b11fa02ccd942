"""Structured Streaming twins: reports as they come, counts, sessions, redeliveries, online tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.stateful import iou
from ..sources.store import Store
from ..sources.tables import REPORT


def report_stream(spark: SparkSession, path: str) -> DataFrame:
    """Detection reports that arrive in a folder, one JSON document a file."""
    return spark.readStream.schema(REPORT).option("multiLine", True).json(path)


def import_stream(reports: DataFrame, store: Store, checkpoint: str):
    """Store every batch of reports. A batch that comes again replaces itself, so restarts repeat nothing."""
    return reports.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.import_reports(batch)).trigger(availableNow=True).start()


def activity(d: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Detections by camera and class in tumbling or sliding windows of event time ``ts``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return d.withWatermark("ts", late).groupBy(window.alias("w"), "camera", "class_name").agg(F.count("*").alias("n")).select("w.start", "w.end", "camera", "class_name", "n")


def sessions(d: DataFrame, gap: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """Segments of tracks: a new one after ``gap`` without a detection."""
    s = d.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "camera", "track_id").agg(F.count("*").alias("n"))
    return s.select("camera", "track_id", "w.start", "w.end", "n")


def first_deliveries(d: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys weren't seen within ``late``."""
    return d.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def online_tracks(d: DataFrame, threshold: float = 0.3, max_gap: int = 2) -> DataFrame:
    """Track each camera and class as detections come; ``track`` is the event that opened it.

    Detections of a batch are taken by frame and event; the state holds open tracks only, those whose last frame is at most
    ``max_gap`` behind. A frame that comes after later ones counts as it comes.
    """
    import pandas as pd

    cols = ["frame_idx", "event_id", "x1", "y1", "x2", "y2"]

    def run(key, batches, state):
        tracks = [list(t) for t in state.get[0]] if state.exists else []
        rows = sorted(r for b in batches for r in b[cols].itertuples(index=False, name=None))
        out = []
        for frame, event, *box in rows:
            tracks = [t for t in tracks if frame - t[1] <= max_gap]
            scored = [(iou(t[2:], box), -i) for i, t in enumerate(tracks)]
            best = max(scored, default=(-1.0, 0))
            if best[0] >= threshold:
                own = tracks[-best[1]]
                own[1:] = [float(frame), *box]
            else:
                own = [float(event), float(frame), *box]
                tracks.append(own)
            out.append((*key, int(event), int(own[0])))
        state.update(([[float(x) for x in t] for t in tracks],))
        yield pd.DataFrame(out, columns=["camera", "class_name", "event_id", "track"])

    grouped = d.select("camera", "class_name", *cols).groupBy("camera", "class_name")
    return grouped.applyInPandasWithState(run, "camera string, class_name string, event_id long, track long", "tracks array<array<double>>", "append", GroupStateTimeout.NoTimeout)
