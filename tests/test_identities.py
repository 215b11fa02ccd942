"""Identities, journeys and evaluation against plain loops."""

import math
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sighthound.operators import identities as I
from sighthound.operators.evaluation import match_truth, reid_counts, tracking_scores
from sighthound.operators.graph import components, numbered
from sighthound.operators.joins import alike_boxes
from sighthound.operators.stateful import deduplicate_people, deduplicate_vehicles, iou, merge_fragments, spatial_leaders


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + chain + [(7, 7), (200, 200), (None, 3)]
    s = Sets()
    for a, b in edges:
        if a is not None:
            s.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: s.root(x) for x in got} and {x for e in edges if e[0] is not None for x in e} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    d = spark.createDataFrame([("a" if i % 3 else "b", (i * 37) % 50, i) for i in range(100)], "g string, k long, i long")
    for g in "ab":
        rows = sorted((r["k"], r["i"], r["no"]) for r in numbered(d, "g", ["k", "i"], "no").collect() if r["g"] == g)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))


def test_alike_boxes(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        x, y, w, h = rng.uniform(-50, 60), rng.uniform(0, 60), rng.uniform(1, 70), rng.uniform(1, 70)
        rows.append((i, "c" if i % 4 else "d", x, y, x + w, y + h))
    rows += [(150 + i, "c", 5.0, 5.0, 5.0, 9.0) for i in range(2)] + [(160 + i, "c", 10.0, 10.0, 20.0, 20.0) for i in range(3)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and iou(a[2:], b[2:]) > 0.5}
    got = [(r["a"], r["b"]) for r in alike_boxes(spark.createDataFrame(rows, "id long, camera string, x1 double, y1 double, x2 double, y2 double"), "camera", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def world(seed):
    rng = np.random.default_rng(seed)
    faces = {k: [v / np.linalg.norm(v) for v in rng.normal(size=(5, 6))] for k in ("person", "vehicle")}
    rows = []
    for i in range(70):
        kind = "person" if i % 3 else "vehicle"
        who = int(rng.integers(5))
        v = faces[kind][who] + rng.normal(size=6) * 0.22
        t = float(rng.integers(0, 1200))
        last = t + float(rng.choice([0.0, 5.0, 200.0, 400.0, 900.0]))
        x, y = float(60 * who + rng.integers(0, 9)), float(rng.integers(0, 9))
        v = None if i % 17 == 0 else [float(q) for q in v / np.linalg.norm(v)]
        colour = ["black", "dark grey", "red", ""][int(rng.integers(4))]
        rows.append((i, "AB"[int(rng.integers(2))], kind, f"{kind} {who}", t, last, x, y, x + 50, y + 40, colour, colour, v))
    rows.append((70, *rows[5][1:]))
    return rows


SCHEMA = "entity_id long, camera string, entity_type string, description string, first_ts double, last_ts double, x1 double, y1 double, x2 double, y2 double, upper string, lower string, embedding array<double>"
GROUP = {"black": "dark", "dark grey": "dark"}


def plain_identities(rows):
    """Matches and classes one pair after the other, the anchor rule looking at the state of the moment."""
    by, pairs, out = {r[0]: r for r in rows}, [], {}
    cos = lambda a, b: float(np.dot(a[12], b[12]))
    for kind, least in (("person", 0.5), ("vehicle", 0.6)):
        own = [r for r in rows if r[2] == kind]
        cand = []
        for a in (r for r in own if r[1] == "A" and r[12]):
            for b in (r for r in own if r[1] == "B" and r[12]):
                gap = min(abs(p - q) for p in a[4:6] for q in b[4:6])
                s = cos(a, b) + (0.15 * (1 - gap / 300) if gap < 300 else 0)
                if s >= least:
                    cand.append((-s, a[0], b[0]))
        used, made = set(), []
        for s, a, b in sorted(cand):
            if not {a, b} & used:
                used |= {a, b}
                made.append((a, b, round(-s, 3)))
        pairs += made
        best = dict.fromkeys(by, 0.0)
        for a in own:
            for b in own:
                if a[0] < b[0] and a[1] == b[1] and a[12] and b[12] and abs(a[4] - b[4]) <= 120 and cos(a, b) >= 0.55:
                    best[a[0]], best[b[0]] = max(best[a[0]], cos(a, b)), max(best[b[0]], cos(a, b))
        s = Sets()
        for a, b, score in made:
            if max(best[a], best[b]) <= score + 0.08:
                s.join(a, b)
        kept = [r for r in own if r[5] - r[4] >= (0.1 if kind == "person" else 300)]
        first = {}
        for r in kept:
            k = (r[1], r[4], r[5], *map(round, r[6:10]))
            s.join(first.setdefault(k, r[0]), r[0])
        anchored = {x for a, b, _ in made if s.root(a) == s.root(b) for x in (a, b)}
        for i, a in enumerate(kept):
            for b in kept[i + 1 :]:
                if a[1] != b[1]:
                    continue
                if kind == "vehicle":
                    if iou(a[6:10], b[6:10]) > 0.5:
                        s.join(a[0], b[0])
                elif a[12] and b[12]:
                    gap = abs(a[4] - b[4])
                    alike = a[10] != "" and GROUP.get(a[10], a[10]) == GROUP.get(b[10], b[10])
                    least = 0.55 if gap <= 120 else 0.68 if alike else 0.8 if gap >= 300 else 0.62 + (gap - 120) / 180 * 0.23
                    if a[0] in anchored and b[0] in anchored and s.root(a[0]) != s.root(b[0]):
                        least = max(least, 0.85)
                    if cos(a, b) >= least:
                        s.join(a[0], b[0])
        out |= {r[0]: s.root(r[0]) for r in kept}
    return {p[:2] for p in pairs}, out


@pytest.mark.parametrize("seed", [1, 2])
def test_identities(spark, seed):
    rows = world(seed)
    e = spark.createDataFrame(rows, SCHEMA)
    matches = I.durable(I.match_cameras(e, "A", "B"))
    assert sorted(tuple(r) for r in I.match_all(e).collect()) == sorted(tuple(r) for a, b in itertools.combinations(sorted({r[1] for r in rows}), 2) for r in I.match_cameras(e, a, b).collect())
    pairs, want = plain_identities(rows)
    assert {(r["a"], r["b"]) for r in matches.collect()} == pairs
    found = I.durable(I.identities(e, matches))
    got = {r["entity_id"]: r["root"] for r in found.collect()}
    assert set(got) == set(want)
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert classes(got) == classes(want)

    seen = I.durable(I.sightings(e, found))
    for kind in ("person", "vehicle"):
        ids = seen.filter(F.col("entity_type") == kind).groupBy("unified_id").agg(F.min("first_ts").alias("t")).orderBy("unified_id").collect()
        assert [r["unified_id"] for r in ids] == list(range(1, len(ids) + 1))
    made = I.durable(I.journeys(I.events(e, seen), seen, I.directions(e, found)))
    js = made.collect()
    assert len({(r["person_id"], r["event"]) for r in js}) == len(js) == len({(r["vehicle_id"], r["event"]) for r in js})
    assert all(r["gap"] <= 600 and 0.1 <= r["confidence"] <= 1 for r in js)
    trips = I.round_trips(made).collect()
    assert all(0 < r["away"] <= 86400 for r in trips)


def test_journey_scores(spark):
    """One departure with three persons: direction beats nearness, and the camera counts."""
    seen = [("person", 1, 11, "A", 0.0, 90.0), ("person", 1, 11, "B", 100.0, 190.0), ("person", 2, 12, "B", 0.0, 199.0), ("person", 3, 13, "A", 0.0, 200.0)]
    s = spark.createDataFrame(seen, "entity_type string, unified_id long, root long, camera string, first_ts double, last_ts double").withColumn("description", F.lit("x"))
    ways = spark.createDataFrame([(11, "A", "B"), (12, "B", "B"), (13, "A", "A")], "root long, from_camera string, to_camera string")
    happened = spark.createDataFrame([("B", 7, "departure", 200.0, "car")], "camera string, vehicle_id long, event string, event_ts double, description string")
    (r,) = I.journeys(happened, s, ways).collect()
    assert (r["person_id"], r["vehicle_id"], r["gap"], r["confidence"]) == (1, 7, 10.0, 1.0)
    assert math.isclose(3 * 1.2 * (1 - math.sqrt(10 / 600)), 3.135, abs_tol=1e-3)


def test_fragments(spark):
    v, u = [1.0, 0.0], [0.0, 1.0]
    box = (0.0, 0.0, 10.0, 10.0)
    rows = [
        ("c", "person", 1, 0, 0.0, 10.0, *box, v), ("c", "person", 2, 1, 20.0, 30.0, 500.0, 0.0, 510.0, 10.0, v), ("c", "person", 3, 2, 25.0, 31.0, *box, u),
        ("c", "person", 4, 3, 110.0, 120.0, *box, None), ("c", "person", 5, 9, 400.0, 410.0, *box, v),
        ("c", "vehicle", 6, 0, 0.0, 10.0, *box, v), ("c", "vehicle", 7, 1, 500.0, 510.0, *box, v), ("c", "vehicle", 8, 2, 520.0, 530.0, 0.0, 0.0, 3.0, 3.0, v), ("c", "vehicle", 9, 3, 540.0, 550.0, *box, u),
    ]
    t = spark.createDataFrame(rows, "camera string, entity_type string, key long, first_frame long, first_ts double, last_ts double, x1 double, y1 double, x2 double, y2 double, embedding array<double>")
    assert {r["key"]: r["leader"] for r in merge_fragments(t).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}


def test_spatial_leaders(spark):
    rng = random.Random(4)
    rows = [("c", i % 3, i, rng.randrange(5) / 4, rng.uniform(0, 400), rng.uniform(0, 300)) for i in range(200)]
    d = spark.createDataFrame([(*r[:4], r[4], r[5], r[4] + 20, r[5] + 10) for r in rows], "camera string, frame_idx long, event_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for g in range(3):
        leaders = []
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2])):
            hit = [k for k in leaders if math.dist(k[4:], r[4:]) < 80]
            want[r[2]] = hit[0][2] if hit else r[2]
            leaders += [] if hit else [r]
    assert {r["id"]: r["leader"] for r in spatial_leaders(d, ["camera", "frame_idx"], "event_id", 80.0).collect()} == want


def test_deduplication(spark):
    rows = [("g", 1, 9000.0, 0, [1.0, 0.0], False), ("g", 2, 8000.0, 1, [1.0, 0.0], True), ("g", 3, 7000.0, 5, [1.0, 0.1], False), ("g", 4, 100.0, 9, [0.0, 1.0], False), ("h", 5, 100.0, 0, [0.0, 1.0], False)]
    d = spark.createDataFrame(rows, "grp string, id long, area double, frame_idx long, embedding array<double>, has_plate boolean")
    assert {r["id"]: r["leader"] for r in deduplicate_people(d, "grp", "id").collect()} == {1: 1, 2: 2, 3: 1, 5: 5}
    assert {(r["leader"], r["representative"], r["n"]) for r in deduplicate_vehicles(d, "grp", "id").collect()} == {(1, 2, 3), (4, 4, 1), (5, 5, 1)}


def test_evaluation(spark):
    rng = random.Random(5)
    gt = [("c" if i % 2 else "d", i, a := rng.randrange(100), a + rng.randrange(1, 60)) for i in range(30)]
    sy = [("c" if i % 2 else "d", i, a := rng.randrange(100), a + rng.randrange(0, 60)) for i in range(30)] + [("e", 99, 0, 5)]
    cand = []
    for g in gt:
        for s in sy:
            over = max(min(g[3], s[3]) - max(g[2], s[2]), 0)
            union = g[3] - g[2] + s[3] - s[2] - over
            if g[0] == s[0] and union and over / union >= 0.3:
                cand.append((-over / union, "|".join(map(str, (g[0], *g[2:]))), f"{s[0]}|{s[1]}", g[1], s[1]))
    used, want = set(), set()
    for _, a, b, g, s in sorted(cand):
        if not {a, b} & used:
            used |= {a, b}
            want.add((g, s))
    x = spark.createDataFrame(gt, "camera string, gt_id long, f0 long, f1 long")
    y = spark.createDataFrame(sy, "camera string, sys_id long, f0 long, f1 long")
    m = match_truth(x, y)
    assert {(r["gt_id"], r["sys_id"]) for r in m.collect()} == want
    t = {r["camera"]: r for r in tracking_scores(x, y, m).collect()}
    assert t["e"]["false_positives"] == 1 and t["e"]["mota"] == 0 and sum(r["true_positives"] for r in t.values()) == len(want)
    claims = [(1, 1, "a"), (1, 1, "b"), (2, 2, "a"), (2, 3, "b"), (3, 2, "b"), (4, None, "a")]
    r = reid_counts(spark.createDataFrame(claims, "identity long, gt long, camera string")).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["precision"]) == (1, 1, 0, 0.5)


def test_evidence(spark):
    from sighthound.operators.evidence import archive_names, case_summary, journey_steps, manifest_totals

    assert tuple(manifest_totals(spark.createDataFrame([(3,), (None,)], "size_bytes long")).first()) == (2, 3)
    s = spark.createDataFrame([(1, "a", 5.0, 2, "/x/q.jpg"), (1, "b", 1.0, 3, None), (2, "a", 0.0, 4, "y.png")], "unified_id long, camera string, first_ts double, entity_id long, crop_path string")
    assert {r["archive_name"] for r in archive_names(s, "person").collect()} == {"crops/persons/P1_sighting_2_a.jpg", "crops/persons/P2_sighting_1_a.png"}
    seen = spark.createDataFrame([("person", 1, "a", 5.0, True), ("person", 1, "b", 50.0, True), ("vehicle", 1, "a", 0.0, False)], "entity_type string, unified_id long, camera string, first_ts double, matched boolean")
    j = spark.createDataFrame([(1, 1, "departure", 20.0, "a")], "vehicle_id long, person_id long, event string, event_ts double, camera string")
    assert [(r["step"], r["gap"]) for r in journey_steps(j, seen).orderBy("ts").collect()] == [("person", 15.0), ("vehicle", 30.0), ("person", None)]
    assert tuple(case_summary(seen, j.filter("false")).first()) == (1, 1, 1, 0)


def test_concurrent(spark):
    from sighthound.operators.stateful import absorb_concurrent

    rng = random.Random(6)
    rows = [("c", "person", i, a := rng.randrange(60), a + rng.randrange(25), x := float(rng.randrange(30)), 0.0, x + 20, 10.0) for i in range(80)]
    want, taken = {}, set()
    order = sorted(rows, key=lambda r: (r[3], r[2]))
    for a in order:
        if a[2] in taken:
            continue
        end = a[4]
        want[a[2]] = a[2]
        taken.add(a[2])
        for b in order:
            if b[2] not in taken and b[3] <= end and b[4] >= a[3] and iou(a[5:], b[5:]) >= 0.4:
                want[b[2]], end = a[2], max(end, b[4])
                taken.add(b[2])
    t = spark.createDataFrame(rows, "camera string, entity_type string, key long, first_frame long, last_frame long, x1 double, y1 double, x2 double, y2 double")
    assert {r["key"]: r["leader"] for r in absorb_concurrent(t, 0.4).collect()} == want and len(set(want.values())) < len(want)
