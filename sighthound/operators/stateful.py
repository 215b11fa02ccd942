"""Operators whose result depends on the order of rows.

Rows stream in order through sorted partitions, and a task holds what is still open of one group only.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from .durable import durable


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = max(a[2] - a[0], 0) * max(a[3] - a[1], 0) + max(b[2] - b[0], 0) * max(b[3] - b[1], 0) - inter
    return inter / union if union > 0 else 0.0


def lanes(df: DataFrame) -> int:
    """Tasks for work that grows faster than its bytes: Spark alone would put a small shuffle into few."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def in_order(df: DataFrame, keys: list[str], order: list[str], more: list[str]) -> DataFrame:
    """``keys``, ``order`` and ``more``, each once, dealt by ``keys`` and sorted by them and ``order`` within partitions."""
    return df.select(*dict.fromkeys([*keys, *order, *more])).repartition(lanes(df), *keys).sortWithinPartitions(*keys, *order)


def group_starts(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Rows of a sorted batch where a group of ``keys`` begins, given the last group before it; and the last group."""
    if not batch.num_rows:
        return np.zeros(0, np.int64), before
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        one, two = batch[k][1:], batch[k][:-1]
        same = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(pc.is_null(one), pc.is_null(two)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    new[0] = before != tuple(batch[k][0].as_py() for k in keys)
    return np.flatnonzero(new), tuple(batch[k][-1].as_py() for k in keys)


def iou_tracker(d: DataFrame, threshold: float = 0.3, max_gap: int = 2) -> DataFrame:
    """Give each detection of (camera, class) the number of a track, in order of frame and event.

    A detection joins the open track of the best overlap of at least ``threshold`` with the track's last box, the older of
    equals, if its last frame is at most ``max_gap`` back; else it opens one. Appends ``track_no``, counted over all
    classes of a camera in order of birth. Stretches with more than ``max_gap`` frames between them go to tasks of their own.
    """

    def run(batches):
        # Columns of an open track: last box and its area, last frame; in order of birth.
        now, at, n, ids, held = None, None, 0, np.zeros(64, np.int64), np.zeros((6, 64))
        for batch in batches:
            births = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *key, frame, event, x1, y1, x2, y2 = row
                if key != now:
                    now, n = key, 0
                elif frame != at and n:
                    open_ = frame - held[5, :n] <= max_gap
                    if not open_.all():
                        kept = np.flatnonzero(open_)
                        ids[: len(kept)], held[:, : len(kept)], n = ids[kept], held[:, kept], len(kept)
                at, area, best = frame, max(x2 - x1, 0) * max(y2 - y1, 0), None
                if n:
                    a, b, c, d, areas, _ = held[:, :n]
                    inter = np.maximum(np.minimum(c, x2) - np.maximum(a, x1), 0) * np.maximum(np.minimum(d, y2) - np.maximum(b, y1), 0)
                    union = areas + area - inter
                    score = inter / np.where(union > 0, union, 1)
                    k = int(score.argmax())
                    best = k if score[k] >= threshold else None
                if best is None:
                    if n == len(ids):  # twice the room
                        ids, held = np.concatenate([ids, ids]), np.concatenate([held, held], 1)
                    best, n = n, n + 1
                    ids[best] = event
                held[:, best] = x1, y1, x2, y2, area, frame
                births.append(int(ids[best]))
            yield pa.RecordBatch.from_arrays([batch["camera"], batch["event_id"], pa.array(births, pa.int64())], ["camera", "event_id", "birth"])

    d = d.withColumn("event_id", F.col("event_id").cast("long"))
    cut = islands(d.select("camera", "class_name", "frame_idx", "event_id", "x1", "y1", "x2", "y2"), ["camera", "class_name"], "frame_idx", "frame_idx", F.lit(max_gap))
    made = in_order(cut, ["camera", "class_name", "island"], ["frame_idx", "event_id"], ["x1", "y1", "x2", "y2"]).mapInArrow(run, "camera string, event_id long, birth long")
    made = durable(made)  # read twice
    births = made.filter("event_id = birth").join(d.select("camera", "event_id", "frame_idx"), ["camera", "event_id"])
    numbers = births.withColumn("track_no", F.row_number().over(W.partitionBy("camera").orderBy("frame_idx", "event_id"))).select("camera", "birth", "track_no")
    return made.join(numbers, ["camera", "birth"]).select("camera", "event_id", "track_no")


def leaders(df: DataFrame, group: str, order: list[str], id_col: str, vector: str, threshold: float, frame: str | None = None) -> DataFrame:
    """``(id_col, leader)``: in order of ``order`` a row of ``group`` joins the first leader whose cosine is ``threshold``
    or more, with ``frame`` only one that isn't in the same or the next frame, else it leads. Rows without a vector are left out.

    A task holds the leaders of one group, not its rows.
    """

    def run(batches):
        now, n, ids, frames, held = None, 0, [], np.zeros(0), np.zeros((0, 0))
        for batch in batches:
            lead = []
            groups, vectors = batch[group].to_pylist(), np.array(batch[vector].to_pylist(), np.float64)
            at = batch[frame].to_pylist() if frame else [0] * len(groups)
            for i, (key, own) in enumerate(zip(groups, batch[id_col].to_pylist(), strict=True)):
                if n and key != now:
                    n, ids = 0, []
                now = key
                hit = held[:n] @ vectors[i] >= threshold if n else np.zeros(0, bool)
                hit = np.flatnonzero(hit & (np.abs(frames[:n] - at[i]) > 1) if frame and n else hit)
                if len(hit):
                    lead.append(ids[hit[0]])
                    continue
                if not n or n == len(held):  # twice the room
                    held = np.concatenate([held[:n].reshape(n, vectors.shape[1]), np.zeros((max(n, 64), vectors.shape[1]))])
                    frames = np.concatenate([frames[:n], np.zeros(len(held) - n)])
                held[n], frames[n] = vectors[i], at[i]
                n += 1
                ids.append(own)
                lead.append(own)
            yield pa.RecordBatch.from_arrays([batch[id_col].cast(pa.int64()), pa.array(lead, pa.int64())], [id_col, "leader"])

    rows = df.filter(F.col(vector).isNotNull())
    return in_order(rows, [group], order, [id_col, vector, *([frame] if frame else [])]).mapInArrow(run, f"{id_col} long, leader long")


def leader_dedup(df: DataFrame, group: str, order: list[str], id_col: str, vector: str, threshold: float) -> DataFrame:
    """Leader clustering within ``group``: in the given order a row joins the first leader whose cosine is ``threshold`` or more, else it leads."""
    return leaders(df, group, order, id_col, vector, threshold)


def absorb_concurrent(t: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Duplicate tracks of a camera and type: by first frame, a track takes in later ones that overlap it in time and whose
    mean boxes overlap by ``threshold``; its last frame grows, its box stays. Gives each tracklet its ``leader``. Stretches
    of frames that no track crosses go to tasks of their own."""

    def run(batches):
        now, heads = None, []
        for batch in batches:
            lead = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *group, first, key, last, x1, y1, x2, y2 = row
                if group != now:
                    now, heads = group, []
                box = (x1, y1, x2, y2)
                heads = [h for h in heads if first <= h[1]]  # rows come by first frame
                head = next((h for h in heads if iou(h[2], box) >= threshold), None)
                if head is None:
                    heads.append([key, last, box])
                    lead.append(key)
                else:
                    head[1] = max(head[1], last)
                    lead.append(head[0])
            yield pa.RecordBatch.from_arrays([batch["key"].cast(pa.int64()), pa.array(lead, pa.int64())], ["key", "leader"])

    cut = islands(t.select("camera", "entity_type", "first_frame", "last_frame", "key", "x1", "y1", "x2", "y2"), ["camera", "entity_type"], "first_frame", "last_frame", F.lit(0))
    return in_order(cut, ["camera", "entity_type", "island"], ["first_frame", "key"], ["last_frame", "x1", "y1", "x2", "y2"]).mapInArrow(run, "key long, leader long")


def islands(df: DataFrame, keys: list[str], start: str, end: str, max_gap: Column) -> DataFrame:
    """Append ``island``: a new one starts where a row begins more than ``max_gap`` after all before it ended, so no merge crosses."""
    w = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) - before > max_gap).cast("int"), F.lit(0))
    return df.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("new")


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors as rows, NaN for a null one."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    full = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.full((len(column), len(full) // int(valid.sum()) if valid.any() else 0), np.nan)
    out[valid] = full.reshape(int(valid.sum()), out.shape[1])
    return out


def wide(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows without any vector at the width of those that have one."""
    return rows if rows.shape[1] == width and width else np.full((len(rows), max(width, 1)), np.nan)


def merge_fragments(t: DataFrame, person_iou: float = 0.3, vehicle_iou: float = 0.2) -> DataFrame:
    """Fragments of one track: by first frame, a track takes in later ones near in time, place and looks. Gives each ``key`` its ``leader``.

    The gap is counted from the leader's growing end; box and vector stay the leader's. Persons up to 90 s apart need the
    place or the looks, vehicles up to 600 s both (and like sizes), or nearly the same box where there are no vectors.
    Stretches of time between which nothing can merge go to tasks of their own.
    """
    keys, order = ["camera", "entity_type", "island"], ["first_frame", "key"]

    def run(batches):
        # Heads in order of birth: key, last second, box and size, vector (no number where there is none).
        now, heads = None, None
        for batch in batches:
            lead = np.zeros(batch.num_rows, np.int64)
            starts, last_group = group_starts(batch, keys, now)
            now, vectors = last_group, unit_rows(batch["embedding"])
            cars, names = batch["entity_type"].to_pylist(), batch["key"].to_numpy().astype(np.int64)
            first, last, x1, y1, x2, y2, earliest = (batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("first_ts", "last_ts", "x1", "y1", "x2", "y2", "earliest"))
            own = np.stack([last, x1, y1, x2, y2, (x2 - x1) * (y2 - y1)])
            begins = {int(i) for i in starts}
            edges, i = sorted({*begins, batch.num_rows, *range(128, batch.num_rows, 128)} - {0}), 0
            for edge in edges:
                # Fixed values, here and below: seconds apart, likeness, overlap of boxes, ratio of sizes.
                car, most = cars[i] == "vehicle", 600 if cars[i] == "vehicle" else 90
                if heads is None or i in begins:
                    heads = (np.zeros(0, np.int64), np.zeros((6, 0)), vectors[:0])
                late = earliest[i] - heads[1][0] <= most  # all that follow are too late for the others
                n, new = int(late.sum()), edge - i
                width = max(vectors.shape[1], heads[2].shape[1])
                v = wide(vectors[i:edge], width)
                # Rows of this slice that come to lead follow the heads before it.
                ids, held, known = (np.concatenate(x, -1) for x in ((heads[0][late], names[i:edge]), (heads[1][:, late], own[:, i:edge]), (wide(heads[2][late], width).T, v.T)))
                looks_all, leads = v @ known, np.zeros(n + new, bool)
                leads[:n] = True
                likely = ~(looks_all < 0.62 - 1e-9)  # also where there is no vector
                for r in range(new):
                    k = i + r
                    upto = n + r
                    near = np.flatnonzero(likely[r, :upto] & leads[:upto] & (first[k] - held[0, :upto] <= most))
                    if len(near):
                        looks = looks_all[r, near]
                        for p in np.flatnonzero((np.abs(looks - 0.62) < 1e-9) | (np.abs(looks - 0.75) < 1e-9)):
                            looks[p] = float(np.ascontiguousarray(known[:, near[p]]) @ v[r])
                        blind, gap = np.isnan(looks), first[k] - held[0, near]
                        w = np.minimum(held[3, near], x2[k]) - np.maximum(held[1, near], x1[k])
                        h = np.minimum(held[4, near], y2[k]) - np.maximum(held[2, near], y1[k])
                        inter = np.maximum(w, 0) * np.maximum(h, 0)
                        size = held[5, n + r]
                        areas = np.maximum(held[3, near] - held[1, near], 0) * np.maximum(held[4, near] - held[2, near], 0) + max(x2[k] - x1[k], 0) * max(y2[k] - y1[k], 0)
                        place = np.where(areas - inter > 0, inter / np.where(areas - inter > 0, areas - inter, 1), 0.0)
                        alike = looks >= np.where(gap < 30, 0.62, 0.75)
                        if car:
                            big = np.maximum(held[5, near], size)
                            even = (big <= 0) | (np.minimum(held[5, near], size) / np.where(big > 0, big, 1) >= 0.4)
                            same = even & np.where(blind, place >= 0.7, (place >= vehicle_iou) & alike)
                        else:
                            same = np.where(blind, place >= 0.5, (place >= person_iou) | alike)
                        same &= blind | (looks >= 0.62)
                        if same.any():
                            head = near[int(same.argmax())]
                            held[0, head] = max(held[0, head], last[k])
                            lead[k] = ids[head]
                            continue
                    leads[n + r], lead[k] = True, names[k]
                heads, i = (ids[leads], held[:, leads], known[:, leads].T), edge
            yield pa.RecordBatch.from_arrays([batch["key"].cast(pa.int64()), pa.array(lead, pa.int64())], ["key", "leader"])

    gap = F.when(F.col("entity_type") == "vehicle", 600.0).otherwise(90.0)
    parts = islands(t, ["camera", "entity_type"], "first_ts", "last_ts", gap)
    back = W.partitionBy(*keys).orderBy(*map(F.desc, order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("earliest", F.min("first_ts").over(back))
    return in_order(parts, keys, order, ["first_ts", "last_ts", "x1", "y1", "x2", "y2", "embedding", "earliest"]).mapInArrow(run, "key long, leader long")


def spatial_leaders(d: DataFrame, group: list[str], id_col: str, radius: float) -> DataFrame:
    """Boxes by falling ``conf`` join the first leader whose centre is under ``radius`` away, else lead. Gives ``(*group, id, leader)``.

    Rows stream through sorted partitions; a task holds the leaders of one group only, in a grid of ``radius`` cells.
    """
    import math

    fields = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    rows = d.select(*group, "conf", F.col(id_col).alias("id"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy")).dropna(subset=["cx", "cy"])
    rows = rows.repartition(*group).sortWithinPartitions(*group, F.desc("conf"), "id")
    n = len(group)

    def run(batches):
        key, grid, born = None, {}, 0
        for batch in batches:
            ids, leads = [], []
            table = batch.to_pydict()
            for r in zip(*(table[c] for c in (*group, "id", "cx", "cy")), strict=True):
                if r[:n] != key:
                    key, grid, born = r[:n], {}, 0
                i, x, y = r[n:]
                gx, gy = math.floor(x / radius), math.floor(y / radius)
                near = [k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in grid.get((gx + dx, gy + dy), ()) if math.hypot(k[2] - x, k[3] - y) < radius]
                if near:
                    leads.append(min(near)[1])
                else:
                    grid.setdefault((gx, gy), []).append((born, i, x, y))
                    born += 1
                    leads.append(i)
                ids.append(i)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in group), pa.array(ids, pa.int64()), pa.array(leads, pa.int64())], [*group, "id", "leader"])

    schema = ", ".join(f"`{c}` {fields[c]}" for c in group) + ", id long, leader long"
    return rows.mapInArrow(run, schema)


def first_returns(moves: DataFrame, key: str, within: float) -> DataFrame:
    """Pairs ``(key, dep, arr, away)`` from moves ``(key, id, ts_sec, back)``: departures in order, each with the first strictly later return that none before it has, if it is at most ``within`` away.

    Read in order of time that is a queue: a return goes to the longest open departure, and departures that are too old
    leave it. Rows stream through sorted partitions; a task holds the open departures of one key only.
    """
    from collections import deque

    kind = {f.name: f.dataType.simpleString() for f in moves.schema.fields}[key]
    rows = moves.select(key, "ts_sec", (~F.col("back")).alias("leaves"), "id").dropna().repartition(key).sortWithinPartitions(key, "ts_sec", "leaves", "id")

    def run(batches):
        now, waiting = None, deque()
        for batch in batches:
            out = []
            for k, ts, leaves, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, waiting = k, deque()
                if leaves:
                    waiting.append((ts, i))
                    continue
                while waiting and ts - waiting[0][0] > within:
                    waiting.popleft()
                if waiting:  # equal times put returns first, so what waits left strictly before
                    at, dep = waiting.popleft()
                    out.append((k, dep, i, ts - at))
            types = (batch.schema.field(key).type, pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(types)], [key, "dep", "arr", "away"])

    return rows.mapInArrow(run, f"`{key}` {kind}, dep long, arr long, away double")


def running_spread(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``(key, n, mean, deviation)``: count, mean and population deviation of the ``value`` of each key, null values left out, from a running mean and sum of squares in ``order`` as SQL engines have it, so that results on a limit fall on the same side.

    Rows stream through sorted partitions; a task holds three numbers of one key only.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]

    def run(batches):
        now, n, total, mean, squares = None, 0, 0, 0.0, 0.0
        for batch in itertools.chain(batches, [None]):
            out = []
            for k, x in zip(*(batch[c].to_pylist() for c in (key, value)), strict=True) if batch is not None else [(None, None)]:
                if k != now or batch is None:
                    if n:
                        out.append((now, n, total / n, (squares / n) ** 0.5))
                    now, n, total, mean, squares = k, 0, 0, 0.0, 0.0
                if x is not None:
                    n, total, old = n + 1, total + x, mean
                    mean += (x - mean) / n
                    squares += (x - mean) * (x - old)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema(types))

    names = (key, "n", "mean", "deviation")
    rows = in_order(df.filter(F.col(value).isNotNull()), [key], order, [value])
    types = [(key, pa_type(rows.schema[key].dataType)), ("n", pa.int64()), ("mean", pa.float64()), ("deviation", pa.float64())]
    return rows.mapInArrow(run, f"`{key}` {kind}, n long, mean double, deviation double")


def reading_order(boxes: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """Append ``place``: boxes of a group from top to bottom, then from left to right, equal corners by id; boxes without a corner come last."""
    order = [F.col(c).asc_nulls_last() for c in ("y1", "x1", id_col)]
    return boxes.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def led_clusters(d: DataFrame, led: DataFrame, group: list[str], id_col: str) -> DataFrame:
    """One row per leader of ``spatial_leaders``: its box and ``conf``, ``num_detections``, and its place in reading order."""
    sizes = led.groupBy(*group, F.col("leader").alias(id_col)).agg(F.count("*").alias("num_detections"))
    return reading_order(sizes.join(d.select(*group, id_col, "conf", "x1", "y1", "x2", "y2"), [*group, id_col]), group, id_col)


def deduplicate_people(df: DataFrame, group: str, id_col: str, threshold: float = 0.47, least_area: float = 2500.0) -> DataFrame:
    """Leaders by falling box area: a person joins the first leader of like looks that isn't in the same or the next frame. Small boxes go unless a group has no others."""
    big = F.max("area").over(W.partitionBy(group)) >= least_area
    kept = df.withColumn("big", big).filter(~F.col("big") | (F.col("area") >= least_area)).withColumn("smaller", -F.col("area"))
    return leaders(kept, group, ["smaller", id_col], id_col, "embedding", threshold, "frame_idx")


def deduplicate_vehicles(df: DataFrame, group: str, id_col: str, threshold: float = 0.7) -> DataFrame:
    """Leaders by falling box area; a cluster is shown by the largest vehicle with a plate, or the largest. Gives ``(leader, representative, n)``."""
    ranked = df.withColumn("smaller", -F.col("area"))
    lead = leader_dedup(ranked.filter("embedding is not null"), group, ["smaller", id_col], id_col, "embedding", threshold)
    best = F.struct("has_plate", "area", (-F.col(id_col)).alias("early"))
    return lead.join(df.select(id_col, "has_plate", "area"), id_col).groupBy("leader").agg(F.max_by(id_col, best).alias("representative"), F.count("*").alias("n"))
