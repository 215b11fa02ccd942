"""The store, the front, the command line and the streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from sighthound.__main__ import parser, run
from sighthound.api import Engine, summarize, summary_text, track_reports
from sighthound.functions.colour import clothing_cluster, hair_colour, vehicle_cluster
from sighthound.functions.text import overlay_time, whole_number
from sighthound.functions.video import motion
from sighthound.operators.stateful import iou_tracker
from sighthound.sources.store import Store, read_manifest, read_written_reports, recorder_segments, recorder_slots, verify, write_reports
from sighthound.sources.tables import read_reports
from sighthound.streaming.live import activity, first_deliveries, import_stream, online_tracks, report_stream, sessions


def report(sha, *frames):
    shape = lambda b: {"class_id": 2, "class_name": b[0], "confidence": b[1], "bbox_xyxy": b[2]}
    return {"sha256": sha, "source_path": f"/v/{sha}", "metadata": {"frame_rate": 10.0}, "detections": [{"frame_index": i, "timestamp_seconds": t, "detections": [shape(b) for b in boxes]} for i, t, boxes in frames]}


TWO = report("beef01", (4, 0.5, [("bus", 0.7, [5, 6, 25, 16])]), (9, 1.125, [("cat", 0.65, [40.5, 3.5, 44, 7])]))


def test_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(TWO))
    (tmp_path / "in" / "b.json").write_text(json.dumps(report("other", (0, 0.0, []))))
    e = Engine(spark, str(tmp_path / "db"))
    counts = {r["sha256"]: (r["frames_imported"], r["detections_imported"]) for r in e.import_reports(str(tmp_path / "in")).collect()}
    assert counts == {"beef01": (2, 2), "other": (1, 0)}
    made = {r["sha256"]: r["created_at"] for r in e.store.table("videos").collect()}
    assert [r["frame_index"] for r in e.query("beef01", "bus", 0.5).collect()] == [4]
    assert [(r["timestamp_seconds"], r["bbox_xyxy"]) for r in e.query("beef01", "cat", start=1.0).collect()] == [(1.125, [40.5, 3.5, 44.0, 7.0])]
    assert e.query("beef01", start=1.125, end=1.125).count() == 1 and e.query("none").count() == 0

    with pytest.raises(ValueError, match="no video"):
        e.store.store_tracks("missing", e.track(str(tmp_path / "in" / "a.json")).drop("sha256"))
    e.track(str(tmp_path / "in" / "a.json"), keep=True)
    assert {(r["class_name"], len(r["points"]), r["label"]) for r in e.tracks("beef01").collect()} == {("bus", 1, "track-1"), ("cat", 1, "track-2")}

    # The same video again with fewer frames: replaced, its time of creation and its tracks kept, others untouched.
    (tmp_path / "in" / "a.json").write_text(json.dumps(report("beef01", (7, 0.7, [("dog", 0.9, [0, 0, 2, 2])]))))
    e.import_reports(str(tmp_path / "in" / "a.json"))
    assert [r["class_name"] for r in e.query("beef01").collect()] == ["dog"] and e.tracks("beef01").count() == 2
    assert {r["sha256"]: r["created_at"] for r in e.store.table("videos").collect()} == made
    assert {r["sha256"]: (r["frames"], r["detections"]) for r in e.reports().collect()} == {"beef01": (1, 1), "other": (1, 0)}

    args = parser().parse_args(["--db", str(tmp_path / "db"), "query", "beef01", "--class", "dog", "--min-conf", "0.5"])
    assert run(spark, args).count() == 1


def test_entities_and_delete(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.delete_camera("a")
    s.append_entities(spark.createDataFrame([("a", 1), ("b", 2)], "camera string, id long"))
    s.append_entities(spark.createDataFrame([("a", 3)], "camera string, id long"))
    assert s.table("entities").count() == 3
    s.delete_camera("a")
    assert [r["id"] for r in s.table("entities").collect()] == [2]


def test_reports_manifest_slots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(TWO))
    reports = read_reports(spark, str(tmp_path / "a.json"))
    write_reports(reports, str(tmp_path / "out"))
    assert read_written_reports(spark, str(tmp_path / "out")).first()["sha256"] == "beef01"
    text = summary_text(summarize(reports)).first()["text"].split("\n")
    assert text[:2] == ["Source: /v/beef01", "SHA-256: beef01"] and text[5] == "Time span covered: 0.50s – 1.12s" and text[7] == "  - bus: 1 detections (first @ 0.50s, last @ 0.50s)"
    (tmp_path / "m.json").write_text(json.dumps([{"source_path": "/a", "sha256": "1"}, {"source_path": "/a", "sha256": "2"}, {"source_path": "/b", "sha256": "9"}]))
    files = spark.createDataFrame([("/a", "2"), ("/b", "9"), ("/moved", "9"), ("/new", "7")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in verify(files, read_manifest(spark, str(tmp_path / "m.json"))).collect()} == {"/a": "MISMATCH", "/b": "MATCH", "/moved": "MATCH", "/new": "NOT_FOUND"}
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="JSON list"):
        read_manifest(spark, str(tmp_path / "bad.json")).collect()
    slots = recorder_slots(spark, (8, 58), (10, 1))
    assert slots.count() == 64
    listing = spark.createDataFrame([("08/58.mp4", True), ("09/00.mp4", False)], "path string, readable boolean")
    states = {r["slot"]: r["state"] for r in recorder_segments(slots, listing).collect()}
    assert (states["08:58"], states["09:00"], states["08:59"]) == ("ok", "unreadable", "missing")


def test_track_fixture(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(report("cafe", (6, 1.5, [("bus", 0.5, [2, 2, 12, 8])]), (7, 1.75, [("bus", 0.6, [2, 2, 12.5, 8.5])]))))
    (r,) = track_reports(read_reports(spark, str(tmp_path / "a.json")), 0.1).collect()
    assert (r["class_name"], r["start_frame"], r["end_frame"], len(r["points"])) == ("bus", 6, 7, 2)


def test_columns(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(overlay_time(F.lit(x))) for x in ("cam 20026_01-05 ,12 : 30:05", "2026-01-05,12:30:05", "no time")] == [None, "2026-01-05 12:30:05", None]
    assert [f(whole_number(F.lit(x))) for x in ("3.9", "-3.9", "x")] == [3, -3, None]
    c = lambda *rows: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("h", "s", "v", "fraction"), r, strict=True)]) for r in rows])
    grey, red, dark, tiny = (90, 10, 120, 0.6), (5, 200, 200, 0.2), (100, 40, 30, 0.3), (120, 255, 255, 0.01)
    assert f(clothing_cluster(c(grey, red, tiny)))["fraction"] == 0.2 and f(clothing_cluster(c(grey, dark)))["fraction"] == 0.3
    assert f(clothing_cluster(c(grey)))["fraction"] == 0.6 and f(clothing_cluster(c(tiny)))["fraction"] == 0.01
    assert f(vehicle_cluster(c(dark, red)))["fraction"] == 0.2 and f(vehicle_cluster(c(dark)))["fraction"] == 0.3
    assert [f(hair_colour(c(*x))) for x in (((15, 100, 200, 0.9), dark), (grey,), (red,))] == ["dark", "unknown", "red"]
    m = f(motion(F.array(F.lit(499.0), F.lit(600.0)), F.lit(10000)))
    assert (m["has_motion"], m["motion_area_pixels"], m["num_moving_objects"]) == (True, 600, 1)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(TWO))
    store = Store(spark, str(tmp_path / "db"))
    import_stream(report_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination(120)
    assert store.table("detections").count() == 2

    rows = [("c", "car", 1, i, i, s, 0.0, 0.0, 1.0 + i / 50, 1.0) for i, s in enumerate([0, 5, 10, 40, 41, 4000])] + [("c", "car", 1, 0, 0, 0, 0.0, 0.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "camera string, class_name string, track_id long, frame_idx long, event_id long, s long, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_020))
    d.coalesce(1).write.parquet(str(tmp_path / "d"))
    live = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "d"))
    drain(activity(live()), "activity")
    assert [r["n"] for r in spark.table("activity").collect()] == [6]
    drain(sessions(live()), "sessions")
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [2, 4]
    drain(first_deliveries(live(), ["event_id"]), "firsts")
    assert spark.table("firsts").count() == 6
    drain(online_tracks(live().filter("event_id > 0")), "tracks")
    batch = {r["event_id"]: r["track_no"] for r in iou_tracker(d.filter("event_id > 0"), 0.3, 2).collect()}
    got = {r["event_id"]: r["track"] for r in spark.table("tracks").collect()}
    assert len(set(got.values())) == len(set(batch.values())) and set(got) == set(batch)
