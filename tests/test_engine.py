"""Fixtures with known answers, and order-dependent operators against plain loops."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sighthound.functions.colour import colour_name
from sighthound.functions.geometry import box, box_iou, temporal_bonus
from sighthound.functions.text import duration, frame_rate
from sighthound.operators.joins import greedy_match, nearest, similar_pairs
from sighthound.operators.stateful import first_returns, iou, iou_tracker, leaders
from sighthound.operators.tracks import split_at_break
from sighthound.sources.tables import file_hashes, numbered_lines, read_packets, read_reports, report_detections, report_frames


def test_reports(spark, tmp_path):
    seen = {3: [("bus", 0.61), ("dog", 0.33)], 4: [], 11: [("bus", 0.47)], 12: [("bus", 0.9), ("cat", 0.5), ("dog", 0.8)]}
    boxes = lambda n: [{"class_id": i, "class_name": c, "confidence": p, "bbox_xyxy": [i, 2.5, 30 + i, 41]} for i, (c, p) in enumerate(seen[n])]
    report = {"sha256": "f00d", "detections": [{"frame_index": n, "timestamp_seconds": n / 4, "detections": boxes(n)} for n in seen]}
    (tmp_path / "r.json").write_text(json.dumps(report))
    r = read_reports(spark, str(tmp_path / "r.json"))
    assert [(f["frame_index"], f["detections_count"]) for f in report_frames(r).orderBy("frame_pos").collect()] == [(3, 2), (4, 0), (11, 1), (12, 3)]
    rows = {x["class_name"]: (x["n"], x["t"]) for x in report_detections(r).groupBy("class_name").agg(F.count("*").alias("n"), F.min("timestamp_seconds").alias("t")).collect()}
    assert rows == {"bus": (3, 0.75), "dog": (2, 0.75), "cat": (1, 3.0)}


def test_hash_and_packets(spark, tmp_path):
    for name, content in (("short", b"three sightings"), ("long", bytes(range(256)) * 9000)):
        (tmp_path / name).write_bytes(content)
        got = file_hashes(spark, str(tmp_path / name), 1000).first()
        assert (got["sha256"], got["size_bytes"]) == (hashlib.sha256(content).hexdigest(), len(content))
    (tmp_path / "p").write_text("0.0,0.04,K_\n\nN/A,0.04,__\nx,1\n0.04,0.04,__\n")
    assert [tuple(r) for r in read_packets(spark, str(tmp_path / "p")).select("ord", "pts", "key_frame").orderBy("ord").collect()] == [(0, 0.0, True), (2, None, False), (4, 0.04, False)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 70) for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join(lines[:10]))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "20000")
    try:
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    for name, want in (("a.txt", lines), ("b.txt", lines[:10])):
        assert [r["line"] for r in sorted((r for r in got if r["path"].endswith(name)), key=lambda r: r["ord"])] == want
    assert sorted(r["ord"] for r in got if r["path"].endswith("a.txt")) == list(range(3000))


@pytest.mark.parametrize(("a", "b", "want"), [((2, 3, 7, 9), (2, 3, 7, 9), 1.0), ((0, 0, 4, 4), (9, 1, 12, 3), 0.0), ((0, 0, 6, 2), (3, 0, 9, 2), 1 / 3)])
def test_iou(spark, a, b, want):
    df = spark.createDataFrame([(*map(float, a), *map(float, b))], [f"{s}{c}" for s in "ab" for c in ("x1", "y1", "x2", "y2")])
    assert abs(df.select(box_iou(box("a"), box("b"))).first()[0] - want) < 1e-12 and abs(want - iou(a, b)) < 1e-12


def test_scalars(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert [f(duration(F.lit(x))) for x in (59.5, 60.0, 3599.0, 3600.0)] == ["60s", "1m 0s", "59m 59s", "1h 0m"]
    assert [f(colour_name(*map(F.lit, x))) for x in ((0, 200, 200), (110, 60, 120), (110, 60, 230), (40, 90, 120), (10, 120, 120))] == ["red", "grey", "white", "green", "brown"]
    assert abs(f(temporal_bonus(F.lit(0.0), F.lit(100.0), F.lit(40.0), F.lit(60.0))) - 0.13) < 1e-12
    assert [f(frame_rate(F.lit(x))) for x in ("30/1", "25", "1/0", "x")] == [30.0, 25.0, None, None]


def test_greedy_match_is_sequential(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = [(i, j, rng.randrange(5) / 4) for i in range(7) for j in range(7) if rng.random() < 0.6]
        used_a, used_b, want = set(), set(), set()
        for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
            if i not in used_a and j not in used_b:
                want.add((i, j))
                used_a.add(i)
                used_b.add(j)
        df = spark.createDataFrame(pairs, "i long, j long, s double")
        for few in (0, 5, 1000):
            assert {(r["i"], r["j"]) for r in greedy_match(df, "i", "j", "s", few=few).collect()} == want


def test_similar_pairs(spark):
    rng = random.Random(1)
    rows = [(i, f"c{rng.randrange(3)}", [rng.gauss(0, 1) for _ in range(4)] if i % 9 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, camera string, embedding array<double>")
    for same in (False, True):
        want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1]) == same and a[2] and b[2] and sum(x * y for x, y in zip(a[2], b[2])) >= 2}
        for block in (4096, 7):
            got = [(r["a"], r["b"]) for r in similar_pairs(df, 2.0, block, same).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_tracker_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(2)}", rng.choice(["bus", "dog"]), rng.randrange(60) * rng.choice([1, 7]), i, x := float(rng.randrange(25)), 0.0, x + 20, 10.0) for i in range(250)]
    want, births = {}, {}
    for key in {r[:2] for r in rows}:
        tracks = []
        for _, _, frame, event, *b in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:4]):
            alive = [t for t in tracks if frame - t["frame"] <= 2]
            top = max(alive, key=lambda t: (iou(t["box"], b), -t["born"]), default=None)
            if top is None or iou(top["box"], b) < 0.3:
                top = {"born": len(tracks), "first": (frame, event)}
                tracks.append(top)
            top.update(frame=frame, box=b)
            want[event] = (key[0], top["first"])
    for camera in ("c0", "c1"):
        births.update({(camera, f): n + 1 for n, f in enumerate(sorted({f for c, f in want.values() if c == camera}))})
    d = spark.createDataFrame(rows, "camera string, class_name string, frame_idx long, event_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r["event_id"]: r["track_no"] for r in iou_tracker(d, 0.3, 2).collect()} == {e: births[w] for e, w in want.items()}


def test_returns(spark):
    """Departures in order, each with the first strictly later return that is free, within a bound, as a loop finds them."""
    rng = random.Random(4)
    rows = [(rng.randrange(3), i, float(rng.randrange(80)), rng.random() < 0.5) for i in range(200)]
    want = set()
    for k in range(3):
        back = sorted((t, i) for key, i, t, b in rows if key == k and b)
        for t, i in sorted((t, i) for key, i, t, b in rows if key == k and not b):
            hit = next((x for x in back if x[0] > t), None)
            if hit and hit[0] - t <= 3:
                back.remove(hit)
                want.add((k, i, hit[1], hit[0] - t))
    df = spark.createDataFrame(rows, "who long, id long, ts_sec double, back boolean")
    assert {tuple(r) for r in first_returns(df, "who", 3.0).collect()} == want


def test_break_that_splits(spark):
    rows = [("c", t, f, 10 * t * 1000 + f, 0.0, 0.0, 10.0, 10.0 if f < 20 or t == 2 else 4.0) for t in (1, 2) for f in range(40)]
    d = spark.createDataFrame(rows, "camera string, track_id long, frame_idx long, event_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["track_id"]: (r["lo"], r["hi"]) for r in split_at_break(d).groupBy("track_id").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi")).collect()}
    assert got == {1: (0, 14), 20003: (15, 39), 2: (0, 39)}


def test_tracker_same_frame(spark):
    rows = [("n", "bus", 5, 1, 3.0, 2.0, 9.0, 8.0), ("n", "bus", 5, 2, 3.0, 2.0, 9.5, 8.5), ("n", "bus", 14, 3, 3.0, 2.0, 9.0, 8.0)]
    d = spark.createDataFrame(rows, "camera string, class_name string, frame_idx long, event_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r["event_id"]: r["track_no"] for r in iou_tracker(d, 0.3, 2).collect()} == {1: 1, 2: 1, 3: 2}


def test_entry_without_training_data():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nearest_is_the_plain_search(spark):
    r = random.Random(5)
    time = lambda: r.choice([None, *(float(r.randrange(60)) for _ in range(9))])
    events = [(r.choice(["a", "a", "b", None]), i, time()) for i in range(200)]
    others = [(r.choice(["a", "b", "c", None]), r.choice([None, *range(9)]), time(), i) for i in range(80)]
    got = nearest(spark.createDataFrame(events, "camera string, e long, at_e double"), spark.createDataFrame(others, "camera string, o long, at_o double, n long"), ["camera"], "at_e", "at_o", 3.0, ["o", "n"])
    want = set()
    for camera, e, at in events:
        near = [(abs(at - t), -1 if o is None else o, n) for c, o, t, n in others if None not in (camera, at, t) and c == camera and abs(at - t) <= 3.0]
        if near:
            want.add((camera, e, *min(near)))
    assert {(x["camera"], x["e"], x["gap"], -1 if x["o"] is None else x["o"], x["n"]) for x in got.collect()} == want and len(want) > 50
    assert nearest(got.filter("false").select("camera", "e", "at_e"), got.select("camera", "o", "at_o"), ["camera"], "at_e", "at_o", 3.0, ["o"]).isEmpty()


@pytest.mark.parametrize("apart", [False, True])
def test_leaders_are_those_of_a_plain_loop(spark, apart):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(400, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(f"g{i % 3}" if i % 7 else None, i, int(draw.integers(40)), vectors[i].tolist() if i % 11 else None) for i in range(400)]
    want, held = {}, {}
    for group, i, frame, vector in sorted(rows, key=lambda x: -x[1]):
        if vector is None:
            continue
        mine = held.setdefault(group, [])
        hit = next((k for k, f, v in mine if np.dot(v, vector) >= 0.8 and (not apart or abs(f - frame) > 1)), None)
        want[i] = i if hit is None else hit
        if hit is None:
            mine.append((i, frame, vector))
    d = spark.createDataFrame([(*x, -x[1]) for x in rows], "grp string, id long, frame int, v array<double>, back long")
    got = {x["id"]: x["leader"] for x in leaders(d, "grp", ["back"], "id", "v", 0.8, "frame" if apart else None).collect()}
    assert got == want and 50 < len(set(want.values())) < len(want)
