"""Reports, packet lines, hashes and manifests written to files, and the store: what is read back from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.text import rounded
from ..operators.stateful import lanes
from ..sources.store import Store, append_manifest, read_manifest, read_written_reports, verify, write_reports
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import detections, file_hashes, read_packets, report_detections, report_frames, table


def _folder(spark, name):
    """A new folder below the one that driver and executors share; a local one where the session runs locally and names none. It goes when the driver ends."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.gettempdir()
    path = f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def _reports(spark, sf):
    """One report per camera, of all its detections."""
    d = detections(spark, sf)
    box = F.struct(F.lit(0).alias("class_id"), F.col("class_name"), F.col("conf").alias("confidence"), F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy"))
    frames = d.groupBy("camera", "frame_idx").agg(F.min("ts_sec").alias("ts"), F.transform(F.sort_array(F.collect_list(F.struct("event_id", box.alias("box")))), lambda x: x["box"]).alias("boxes"))
    frame = F.struct(F.col("frame_idx").alias("frame_index"), F.col("ts").alias("timestamp_seconds"), F.col("boxes").alias("detections"), F.lit(None).cast("struct<has_motion:boolean,motion_percentage:double,motion_area_pixels:bigint,num_moving_objects:int>").alias("motion"))
    g = frames.groupBy("camera").agg(F.sort_array(F.collect_list(frame)).alias("detections"))
    meta = "struct<metadata_backend:string,duration_seconds:double,size_bytes:bigint,bit_rate:bigint,codec:string,width:int,height:int,frame_rate:double,frame_count:bigint,creation_time:string>"
    return g.select(F.sha2("camera", 256).alias("sha256"), F.concat(F.lit("/footage/"), "camera").alias("source_path"), F.lit("model").alias("model_path"), F.lit(0.25).alias("confidence_threshold"), F.lit(2).alias("frame_stride"), F.lit("cpu").alias("device"), F.lit(640).alias("imgsz"), F.lit(None).cast(meta).alias("metadata"), "detections")


def written_reports(spark, sf):
    """Boxes of reports that were written as JSON and read again."""
    path = _folder(spark, "reports")
    write_reports(_reports(spark, sf), path)
    d = report_detections(read_written_reports(spark, path))
    return d.select("sha256", "frame_pos", "frame_index", "box_pos", "class_name", rounded("confidence", 6).alias("confidence"), "x1", "y2")


def written_frames(spark, sf):
    path = _folder(spark, "reports")
    write_reports(_reports(spark, sf), path)
    return report_frames(read_written_reports(spark, path)).select("sha256", "frame_pos", "frame_index", rounded("timestamp_seconds", 6).alias("at"), F.col("detections_count").cast("long").alias("n"))


def _store(spark, sf):
    store = Store(spark, _folder(spark, "store"))
    store.import_reports(_reports(spark, sf))
    return store


def imported_counts(spark, sf):
    """What an import says of each video, when all are imported twice."""
    reports, store = _reports(spark, sf), Store(spark, _folder(spark, "store"))
    store.import_reports(reports)
    return store.import_reports(reports).select("sha256", "frames_imported", "detections_imported")


def stored_query(spark, sf):
    """A video's detections by class, confidence and time, boxes as lists again."""
    store = _store(spark, sf)
    sha = store.table("videos").select(F.min("sha256")).first()[0]
    got = store.query_detections(sha, "click", 0.2, (3600.0, 2_000_000.0))
    return got.select("frame_index", rounded("timestamp_seconds", 6).alias("at"), "class_name", rounded("confidence", 6).alias("confidence"), F.array_join(F.transform("bbox_xyxy", lambda x: x.cast("long").cast("string")), ",").alias("bbox"))


def stored_tracks(spark, sf):
    """Tracks that replaced others, with their points in order."""
    store = _store(spark, sf)
    d = detections(spark, sf).filter("camera = 'cam1'")
    sha = d.sparkSession.range(1).select(F.sha2(F.lit("cam1"), 256)).first()[0]
    points = F.sort_array(F.collect_list(F.struct(F.col("frame_idx").alias("frame_index"), F.col("ts_sec").alias("timestamp_seconds"), F.col("conf").alias("confidence"))))
    t = d.groupBy("track_id").agg(F.min("class_name").alias("class_name"), F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.min("ts_sec").alias("start_time"), F.max("ts_sec").alias("end_time"), points.alias("points"))
    store.store_tracks(sha, t.limit(3).withColumn("class_name", F.lit("old")))
    store.store_tracks(sha, t)
    q = store.query_tracks(sha, "click")
    return q.select("track_id", "label", "start_frame", "end_frame", F.size("points").cast("long").alias("n"), F.col("points")[0]["frame_index"].alias("first_frame"))


def deleted_camera(spark, sf):
    """Entities and their history without a camera, one of whose runs came twice."""
    store = Store(spark, _folder(spark, "store"))
    d = detections(spark, sf)
    e = d.groupBy("camera", F.col("track_id").alias("entity_id")).agg(F.min("entity_type").alias("entity_type"))
    store.append_entities(e)
    store.append_entities(e.filter("camera = 'cam3'"))
    store.append_history(d.select(F.col("track_id").alias("entity_id"), "camera", "frame_idx"))
    store.delete_camera("cam1")
    frames = store.table("history").groupBy("entity_id").agg(F.count("*").alias("frames"))
    return store.table("entities").join(frames, "entity_id").groupBy("camera", "entity_type").agg(F.count("*").alias("n"), F.sum("frames").alias("frames"))


def packet_lines(spark, sf):
    """Packet times read from lines of text, some of them blank, short or without a time, over several files' splits."""
    path = _folder(spark, "packets")
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    l = table(spark, sf, "lineitem").select(*order)  # noqa: E741
    # Files follow each other in order; a task sorts a quarter of what one input split holds, or less.
    l = l.repartitionByRange(max(lanes(l), 4 * l.rdd.getNumPartitions()), *order).sortWithinPartitions(*order)  # noqa: E741
    pts = F.when(F.col("l_linenumber") == 3, "N/A").otherwise(F.col("l_quantity").cast("string"))
    line = F.when(F.col("l_linenumber") == 5, "").when(F.col("l_linenumber") == 6, "short,line").otherwise(F.concat_ws(",", pts, F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "K__").otherwise("___")))
    l.select(line.alias("value")).write.text(path)
    return read_packets(spark, path, on=True).select("ord", "pts", "duration", "key_frame")


def hashed_files(spark, sf):
    """Files of texts with their sizes and digests, against a manifest that grew twice and has one wrong entry."""
    path = _folder(spark, "files")
    c = table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k"))
    c.repartition(5, "k").write.partitionBy("k").option("lineSep", "|").text(f"{path}/files")
    files = file_hashes(spark, f"{path}/files/*/part-*").withColumn("k", F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int"))
    entry = c.select(F.col("k"), F.sha2(F.concat(F.when(F.col("k") == 7, F.lit("x")).otherwise(F.col("value")), F.lit("|")), 256).alias("sha256")).join(files.select("k", F.col("path").alias("source_path"), "size_bytes"), "k").withColumn("ingested_at", F.lit("now"))
    append_manifest(spark, f"{path}/manifest.json", entry.filter("k < 10").orderBy("k"))
    append_manifest(spark, f"{path}/manifest.json", entry.filter("k between 10 and 19").orderBy("k"))
    got = verify(files, read_manifest(spark, f"{path}/manifest.json"))
    return got.select("k", "size_bytes", "sha256", "state")


def recorder_states(spark, sf):
    """Minutes of a recorder whose file is missing: the anti join of what should be there and what is."""
    from ..sources.store import recorder_segments, recorder_slots

    d = detections(spark, sf).withColumn("m", F.floor(F.col("ts_sec") / 60) % 1440).filter("camera = 'cam0'")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    listing = d.select(F.concat(two(F.floor(F.col("m") / 60)), F.lit("/"), two(F.col("m") % 60), F.lit(".mp4")).alias("path"), (F.col("event_id") % 3 > 0).alias("readable"))
    return recorder_segments(recorder_slots(spark, (7, 45), (19, 10)), listing)


_FRAMES = "f AS (SELECT camera, frame_idx, min(ts_sec) AS ts, count(*) AS n, row_number() OVER (PARTITION BY camera ORDER BY frame_idx)::INTEGER - 1 AS frame_pos FROM d GROUP BY camera, frame_idx)"
PLANS = {
    "written_reports": (written_reports, f"WITH {D}, {_FRAMES} SELECT sha256(d.camera) AS sha256, frame_pos, frame_idx AS frame_index, row_number() OVER (PARTITION BY d.camera, frame_idx ORDER BY event_id)::INTEGER - 1 AS box_pos, class_name, round(conf, 6) AS confidence, x1, y2 FROM d JOIN f USING (camera, frame_idx)"),
    "written_frames": (written_frames, f"WITH {D}, {_FRAMES} SELECT sha256(camera) AS sha256, frame_pos, frame_idx AS frame_index, round(ts, 6) AS at, n FROM f"),
    "imported_counts": (imported_counts, f"WITH {D} SELECT sha256(camera) AS sha256, count(DISTINCT frame_idx) AS frames_imported, count(*) AS detections_imported FROM d GROUP BY camera"),
    "stored_query": (stored_query, f"WITH {D}, {_FRAMES} SELECT frame_idx AS frame_index, round(ts, 6) AS at, class_name, round(conf, 6) AS confidence, concat_ws(',', x1::BIGINT, y1::BIGINT, x2::BIGINT, y2::BIGINT) AS bbox FROM d JOIN f USING (camera, frame_idx) WHERE sha256(camera) = (SELECT min(sha256(camera)) FROM d) AND class_name = 'click' AND conf >= 0.2 AND ts >= 3600 AND ts <= 2000000"),
    "stored_tracks": (stored_tracks, f"WITH {D}, t AS (SELECT track_id, min(class_name) AS c, min(frame_idx) AS a, max(frame_idx) AS b, count(*) AS n FROM d WHERE camera = 'cam1' GROUP BY track_id) SELECT track_id, 'track-' || track_id AS label, a AS start_frame, b AS end_frame, n, a AS first_frame FROM t WHERE c = 'click'"),
    "deleted_camera": (deleted_camera, f"WITH {D}, e AS (SELECT camera, track_id, min(entity_type) AS entity_type, count(*) AS frames FROM d WHERE camera <> 'cam1' GROUP BY ALL), x AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE camera = 'cam3') SELECT camera, entity_type, count(*) AS n, sum(frames)::BIGINT AS frames FROM x GROUP BY ALL"),
    "packet_lines": (packet_lines, """WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS ord FROM lineitem)
 SELECT ord, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS pts, l_partkey::DOUBLE AS duration, l_suppkey % 2 = 0 AS key_frame FROM l WHERE l_linenumber NOT IN (5, 6)"""),
    "hashed_files": (hashed_files, "SELECT n_nationkey AS k, length(n_name) + 1 AS size_bytes, sha256(n_name || '|') AS sha256, CASE WHEN n_nationkey = 7 THEN 'MISMATCH' WHEN n_nationkey < 20 THEN 'MATCH' ELSE 'NOT_FOUND' END AS state FROM nation"),
    "recorder_states": (recorder_states, f"""WITH {D}, s AS (SELECT unnest(range(465, 1151)) AS m), n AS (SELECT floor(ts_sec / 60)::BIGINT % 1440 AS m, bool_or(event_id % 3 > 0) AS ok FROM d WHERE camera = 'cam0' GROUP BY 1)
 SELECT lpad((s.m // 60)::VARCHAR, 2, '0') || ':' || lpad((s.m % 60)::VARCHAR, 2, '0') AS slot, lpad((s.m // 60)::VARCHAR, 2, '0') || '/' || lpad((s.m % 60)::VARCHAR, 2, '0') || '.mp4' AS path, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'ok' ELSE 'unreadable' END AS state FROM s LEFT JOIN n USING (m)"""),
}
