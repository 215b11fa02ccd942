"""Findings of the third round: rounding and spreads as in SQL, joins and matchings against plain loops."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sighthound.functions.text import rounded
from sighthound.plans.registry import ORACLE_SQL, QUERIES

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar"


def both(spark, name, folder):
    """Rows of a query and of its SQL over ``folder``/events.parquet."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    got = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    return sorted(tuple(r[c] for c in names) for r in QUERIES[name](spark, str(folder)).collect()), sorted(got.fetchall())


def test_rounded_near_halves(spark):
    values = [946378.4845499999, 0.00005, 1.00005, -2.50005, 618407.92295, 1e15 + 0.5, 0.0, None, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x", 4)).collect()]
    want = [duckdb.execute("select round(?::double, 4)", [v]).fetchone()[0] for v in values]
    assert repr(got) == repr(want)
    assert spark.range(1).select(F.round(F.lit(values[0]), 4)).first()[0] != want[0]


def test_presence_sums_near_a_half(spark, tmp_path):
    duckdb.execute(f"copy (select * from '/root/testdata/sf0.1/events.parquet' where user_id // 4 in (332, 350)) to '{tmp_path}/events.parquet'")
    got, want = both(spark, "presence", tmp_path)
    assert got == want and got


def test_presence_hundredths_near_a_half(spark, tmp_path):
    """Times off camera of 2188559.175 s, just under 218855917.5 hundredths in double."""
    duckdb.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_microseconds(t::bigint) as ts, 1 as user_id, 'view' as event_type, 1.0 as value, '' as props
        from (values (0, 0), (1, 2188559175000)) v(i, t)) to '{tmp_path}/events.parquet'""")
    got, want = both(spark, "presence", tmp_path)
    assert got == want and got[0][-1] == "2188559.17"


def test_gop_spread_on_the_limit(spark, tmp_path):
    """Distances of key frames whose spread is half of their mean: the running sums of SQL end just above it."""
    lines = (3, 6, 15, 19, 24, 29, 33, 42, 55, 57, 64, 68, 75)
    rows = ", ".join(f"({i}, {u}, '{'click' if i in lines else 'view'}')" for u in (7, 8) for i in range(1, 80))
    duckdb.execute(f"""copy (select i + 100 * u as event_id, timestamp '2024-01-01' + to_minutes(i) as ts, u::bigint as user_id, t as event_type, 1.0 as value, '' as props
        from (values {rows}, (1, 9, 'click'), (2, 9, 'click')) v(i, u, t)) to '{tmp_path}/events.parquet'""")
    got, want = both(spark, "gop_cv", tmp_path)
    assert got == want and got == [(7, 13, 0.5, True), (8, 13, 0.5, True)]


def plain_truth(truths, tracks, least=0.3):
    """Pairs by falling overlap, one after the other."""
    pairs = []
    for c, g, g0, g1 in truths:
        for d, s, s0, s1 in tracks:
            inter = max(min(g1, s1) - max(g0, s0), 0)
            union = (g1 - g0) + (s1 - s0) - inter
            if c == d and union > 0 and inter / union >= least:
                pairs.append((-inter / union, f"{c}|{g0}|{g1}", f"{d}|{s}", g, (c, g, s, inter / union)))
    one, two, out = set(), set(), set()
    for _, a, b, _, row in sorted(pairs):
        if a not in one and b not in two:
            one.add(a)
            two.add(b)
            out.add(row)
    return out


@pytest.mark.parametrize("wide", [12, 2000])
def test_truth_matches_against_a_loop_without_all_pairs(spark, monkeypatch, wide):
    """Ties, repeated frames, tracks of several extents, stretches apart; no join makes pairs, and small blocks are passed over."""
    import random

    from sighthound.operators import evaluation

    rng = random.Random(wide)
    span = lambda off: (lambda a: (a, a + rng.randrange(wide)))(off + rng.randrange(wide))
    truths = [("AB"[i % 2], i, *span(4 * wide * (i % 3))) for i in range(240)]
    tracks = [("AB"[i % 2], i % 200, *span(4 * wide * (i % 3))) for i in range(260)]
    monkeypatch.setattr(evaluation, "BEST", 3)
    monkeypatch.setattr(evaluation, "BLOCK", 4)
    g = spark.createDataFrame([*truths, ("A", 900, None, 5)], "camera string, gt_id long, f0 long, f1 long")
    s = spark.createDataFrame([*tracks, (None, 900, 1, 5)], "camera string, sys_id long, f0 long, f1 long")
    made = evaluation.match_truth(g, s)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) > 20 and set(got) == plain_truth(truths, tracks)


def some_events(folder, n=400, users=24, days=3, seed=5):
    duckdb.execute(f"select setseed(0.{seed})")
    duckdb.execute(f"""copy (select i as event_id, timestamp '2024-01-01' + to_minutes((random() * {days} * 1440)::int) as ts, (random() * {users - 1})::bigint as user_id,
        case when random() < 0.3 then 'click' else 'view' end as event_type, (random() * 100)::double as value, '' as props from range({n}) t(i)) to '{folder}/events.parquet'""")


def test_tracking_quality_counts_the_loop_s_matches(spark, tmp_path):
    some_events(tmp_path)
    from sighthound.plans import identity

    gt, system = identity._truth(spark, str(tmp_path))
    want = plain_truth([tuple(r) for r in gt.collect()], [tuple(r) for r in system.collect()])
    made = QUERIES["tracking_quality"](spark, str(tmp_path))
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()  # no pairs were written
    assert {r["camera"]: r["true_positives"] for r in made.collect()} == {c: sum(x[0] == c for x in want) for c in ("cam0", "cam1", "cam2", "cam3")}


def test_boxes_that_meet_in_time_against_a_loop(spark):
    """Rows over many buckets, of no length, of equal start, without a box or a time; the plan makes no pairs by a join."""
    import random

    from sighthound.operators.joins import overlapping_boxes
    from sighthound.operators.stateful import iou

    rng, rows = random.Random(3), []
    for i in range(300):
        start, x, y = float(rng.randrange(-50, 400)), rng.randrange(30), rng.randrange(30)
        rows.append(("AB"[i % 2], i, i % 7, start, start + rng.choice([0, 1, 9, 60, 500]), float(x), float(y), float(x + rng.randrange(40)), float(y + rng.randrange(1, 40))))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[3] <= b[4] and b[3] <= a[4] and iou(a[5:], b[5:]) >= 0.25:
                want.add((frozenset([a[1:3], b[1:3]]), iou(a[5:], b[5:])))
    odd = [("A", 900, 0, 1.0, 2.0, None, 1.0, 2.0, 3.0), ("A", 901, 0, None, 2.0, 0.0, 0.0, 30.0, 30.0), (None, 902, 0, 1.0, 2.0, 0.0, 0.0, 30.0, 30.0)]
    t = spark.createDataFrame(rows + odd, "camera string, id long, part int, t0 double, t1 double, x1 double, y1 double, x2 double, y2 double")
    made = overlapping_boxes(t, ["camera"], "t0", "t1", ["id", "part"], 0.25, 40.0)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    got = [(frozenset([(r["a_id"], r["a_part"]), (r["b_id"], r["b_part"])]), r["iou"]) for r in made.collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    assert overlapping_boxes(t.limit(0), ["camera"], "t0", "t1", ["id", "part"], 0.25, 40.0).count() == 0


def test_signed_nearest_chooses_before_the_join(spark, tmp_path):
    """Persons seen twice as far before as after, and twice in one minute: no window over pairs, the rows of SQL."""
    some_events(tmp_path, n=900, users=16, days=9)
    got, want = both(spark, "signed_nearest", tmp_path)
    assert got == want and len(got) > 20
    plan = QUERIES["signed_nearest"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_lines_are_numbered_over_files(spark, tmp_path):
    """Files by name, splits within them, an empty one; a file alone counts from 0."""
    from sighthound.sources.tables import numbered_lines

    sizes = [3, 0, 4000, 1, 700]
    for i, n in enumerate(sizes):
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{i},{k}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r["line"] for r in sorted(numbered_lines(spark, str(tmp_path), on=True).collect(), key=lambda r: r["ord"])]
        assert got == [f"{i},{k}" for i, n in enumerate(sizes) for k in range(n)]
        assert {r["ord"] - int(r["line"].split(",")[1]) for r in numbered_lines(spark, str(tmp_path)).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_packet_lines_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from sighthound.plans import stored

    monkeypatch.setattr(stored, "_folder", lambda *_: str(tmp_path / "packets"))
    QUERIES["packet_lines"](spark, "/root/testdata/sf0.001")
    assert len([f for f in Path(tmp_path / "packets").glob("part-*") if f.stat().st_size]) > 1


def test_tracker_of_a_crowd_against_a_loop(spark):
    """More open tracks than the first room holds, equal overlaps, empty boxes, tracks that end; the stream is run once."""
    import random

    from sighthound.operators.stateful import iou, iou_tracker

    rng, rows = random.Random(4), []
    for i in range(700):
        x, y = rng.randrange(0, 400, 10), rng.randrange(0, 300, 10)
        rows.append((i, "A", "k", i // 60 + (9 if i > 500 else 0), float(x), float(y), float(x + rng.choice([0, 20, 30])), float(y + 20)))
    tracks, want = [], {}
    for e, _, _, frame, *b in rows:
        tracks = [k for k in tracks if frame - k[1] <= 2]
        hits = [(iou(k[2], b), -n, k) for n, k in enumerate(tracks) if iou(k[2], b) >= 0.3]
        k = max(hits, key=lambda h: h[:2])[2] if hits else None
        if k is None:
            k = [e, frame, b]
            tracks.append(k)
        k[1], k[2] = frame, b
        want[e] = k[0]
    numbers = {b: n + 1 for n, b in enumerate(sorted(set(want.values())))}
    d = spark.createDataFrame(rows, "event_id long, camera string, class_name string, frame_idx long, x1 double, y1 double, x2 double, y2 double")
    made = iou_tracker(d)
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["event_id"]: r["track_no"] for r in made.collect()} == {e: numbers[b] for e, b in want.items()} and len(numbers) > 64


@pytest.mark.parametrize("blind", [0.0, 0.4, 1.0])
def test_fragments_of_a_crowd_against_a_loop(spark, blind):
    """Many open heads over several slices, with and without vectors, likeness right at the limits."""
    import random

    import numpy as np

    from sighthound.operators.stateful import iou, merge_fragments

    rng, rows = random.Random(6), []
    for i in range(600):
        kind, t = "person" if i % 2 else "vehicle", float(rng.randrange(0, 3000))
        angle = rng.choice([0.0, np.arccos(0.62), np.arccos(0.75), 0.9, 1.6]) + rng.randrange(3) * 2.0
        v = None if rng.random() < blind else [float(np.cos(angle)), float(np.sin(angle))]
        x, y, w = rng.randrange(60), rng.randrange(60), rng.choice([10, 30, 40])
        rows.append((i, "A", kind, int(t // 60), t, t + rng.choice([0, 30, 500]), float(x), float(y), float(x + w), float(y + 30), v))
    want, heads = {}, []
    for key, _, kind, frame, first, last, *box, v in sorted(rows, key=lambda r: (r[3], r[0])):
        size = (box[2] - box[0]) * (box[3] - box[1])
        for h in heads:
            gap, place = first - h[1], iou(h[2], box)
            looks = None if h[4] is None or v is None else float(np.asarray(h[4]) @ np.asarray(v))
            if h[5] != kind or gap > (600 if kind == "vehicle" else 90) or (looks is not None and looks < 0.62):
                continue
            alike, big = looks is not None and looks >= (0.62 if gap < 30 else 0.75), max(h[3], size)
            if kind == "vehicle":
                same = (big <= 0 or min(h[3], size) / big >= 0.4) and (place >= 0.7 if looks is None else place >= 0.2 and alike)
            else:
                same = place >= (0.5 if looks is None else 0.3) or alike
            if same:
                h[1] = max(h[1], last)
                want[key] = h[0]
                break
        else:
            heads.append([key, last, box, size, v, kind])
            want[key] = key
    t = spark.createDataFrame(rows, "key long, camera string, entity_type string, first_frame long, first_ts double, last_ts double, x1 double, y1 double, x2 double, y2 double, embedding array<double>")
    got = {r["key"]: r["leader"] for r in merge_fragments(t).collect()}
    assert got == want and len(set(want.values())) < 600


def test_matches_of_equal_vectors_against_a_loop(spark):
    """Many fragments of few vectors: equal scores go by fragment, those near in time go first; only vectors are paired by the block join."""
    import random

    from sighthound.operators import identities as I

    rng, rows = random.Random(8), []
    vectors = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0], [0.25, 0.75], None]
    for i in range(160):
        t = float(rng.randrange(0, 4000, 50))
        rows.append((rng.randrange(10**6) * 1000 + i, "AB"[i % 2], "person" if i % 3 else "vehicle", t, t + rng.choice([0.0, 100.0]), vectors[rng.choice([0, 0, 1, 2, 3, 4])]))
    want = set()
    for kind, least in (("person", 0.5), ("vehicle", 0.6)):
        pairs, used = [], set()
        for a in rows:
            for b in rows:
                if a[1] == "A" and b[1] == "B" and a[2] == b[2] == kind and a[5] and b[5]:
                    gap = min(abs(p - q) for p in a[3:5] for q in b[3:5])
                    score = sum(x * y for x, y in zip(a[5], b[5])) + (0.15 * (1 - gap / 300) if gap < 300 else 0)
                    pairs += [(-score, a[0], b[0])] if score >= least else []
        for _, a, b in sorted(pairs):
            if not {a, b} & used:
                used |= {a, b}
                want.add((a, b, kind))
    e = spark.createDataFrame(rows, "entity_id long, camera string, entity_type string, first_ts double, last_ts double, embedding array<double>")
    made = I.match_cameras(e, "A", "B")
    got = [(r["a"], r["b"], r["entity_type"]) for r in made.collect()]
    assert len(got) == len(set(got)) > 30 and set(got) == want
    assert "members" in made._jdf.queryExecution().optimizedPlan().toString()
    assert I.match_cameras(e.limit(0), "A", "B").count() == 0
