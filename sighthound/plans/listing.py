"""Listings, searches, overlays, plate reading, texts and small formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import dot, normalised
from ..functions.text import class_rgb, clock_from, confidence_band, file_stem, first_filled, person_text, rounded, vehicle_text
from ..functions.video import frame_index, frame_seconds, padded, region, similarity_index, upscale
from ..operators.reading import accepted_words, combined, success_rate, sure_text
from ..operators.stateful import lanes
from ..operators.tracks import TRACKLETS_SQL as T
from ..operators.tracks import split_at_break, timeline, tracklets
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import GALLERY_SQL as G
from ..sources.tables import detections, gallery, table


def entities(spark, sf):
    """Entities from ``part``: a camera, a type, colours and a description each."""
    p = table(spark, sf, "part")
    upper = F.element_at(F.split("p_name", " "), 1)
    kind = F.when(F.col("p_partkey") % 3 == 0, "vehicle").otherwise("person")
    return p.select("p_partkey", F.concat(F.lit("cam"), (F.col("p_size") % 4).cast("string")).alias("camera"), kind.alias("entity_type"), upper.alias("upper_color"), F.lower("p_type").alias("lower_color"),
                    (F.col("p_partkey") % 7).alias("run_id"), F.when(kind == "vehicle", vehicle_text(upper, F.element_at(F.split("p_name", " "), 2))).otherwise(person_text(upper, F.lower("p_type"))).alias("description"))


E = """e AS (SELECT *, CASE WHEN entity_type = 'vehicle' THEN upper_color || ' ' || split_part(p_name, ' ', 2) ELSE upper_color || ' top, ' || lower_color || ' bottom' END AS description FROM
 (SELECT p_partkey, p_name, 'cam' || (p_size % 4) AS camera, CASE WHEN p_partkey % 3 = 0 THEN 'vehicle' ELSE 'person' END AS entity_type, split_part(p_name, ' ', 1) AS upper_color, lower(p_type) AS lower_color, p_partkey % 7 AS run_id FROM part))"""


def search(e, cameras=None, entity_type=None, text=None, upper=None, lower=None, run=None):
    """Entities that meet all conditions that are given; ``text`` is found in descriptions whatever its case, with % and _ as wildcards."""
    equal = {"entity_type": entity_type, "upper_color": upper, "lower_color": lower, "run_id": run}
    if cameras:
        e = e.filter(F.col("camera").isin(cameras))
    if text:
        e = e.filter(F.col("description").ilike(f"%{text}%"))
    for column, wanted in equal.items():
        if wanted is not None:
            e = e.filter(F.col(column) == wanted)
    return e


def entity_listing(spark, sf):
    e = search(entities(spark, sf), cameras=["cam1"], run=3)
    return e.select("camera", "entity_type", "p_partkey", "run_id").orderBy("camera", "entity_type", "p_partkey")


def appearance_search(spark, sf):
    return search(entities(spark, sf), ["cam0", "cam2"], "person", "_D%tOp", upper="red").select("p_partkey", "camera", "description")


def camera_paths(spark, sf):
    """One recording per camera: the first path in code point order."""
    d = detections(spark, sf).select("camera", F.concat(F.lit("/footage/"), "camera", F.lit("/"), F.col("track_id").cast("string"), F.lit(".part.mp4")).alias("path"))
    return d.groupBy("camera").agg(F.min("path").alias("path")).select("camera", "path", file_stem(F.col("path")).alias("label"))


def frame_lookup(spark, sf):
    """Boxes to draw on one frame of a camera: frames of entities joined with these."""
    d = detections(spark, sf)
    frames = d.filter("camera = 'cam2' and frame_idx between 14000 and 14400").select(F.col("track_id").alias("entity_id"), "frame_idx", "event_id", "x1", "y1", "x2", "y2")
    who = d.groupBy("camera", F.col("track_id").alias("entity_id")).agg(F.min("entity_type").alias("entity_type"), F.count("*").alias("frames"))
    j = frames.join(who.filter("camera = 'cam2'"), "entity_id")
    crop = padded([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640.0), F.lit(480.0), 5)
    return j.select("entity_id", "entity_type", "frames", "frame_idx", "event_id", *[c.alias(f"c{i}") for i, c in enumerate(crop)])


def least_box(spark, sf):
    d = detections(spark, sf).filter((F.col("h") >= 50) & (F.col("w") >= 20))
    return d.groupBy("camera", "entity_type").agg(F.count("*").alias("n"))


def entity_counts(spark, sf):
    g = detections(spark, sf).groupBy("camera").agg(F.countDistinct(F.when(F.col("entity_type") == "person", F.col("track_id"))).alias("persons"), F.countDistinct(F.when(F.col("entity_type") == "vehicle", F.col("track_id"))).alias("vehicles"))
    return g


def running_best(spark, sf):
    """Detections of each track that are surer than all before them."""
    w = W.partitionBy("camera", "track_id").orderBy("frame_idx", "event_id").rowsBetween(W.unboundedPreceding, -1)
    d = detections(spark, sf).withColumn("before", F.max("conf").over(w))
    return d.filter("before is null or conf > before").select("event_id", "camera", "track_id", rounded("conf", 6).alias("conf"))


def report_preview(spark, sf):
    """The first ten boxes of each camera's report."""
    w = W.partitionBy("camera").orderBy("frame_idx", "event_id")
    return detections(spark, sf).withColumn("place", F.row_number().over(w)).filter("place <= 10").select("camera", "place", "event_id")


def _words(spark, sf):
    """Words read off plates: two or three per part, some unclean, some unsure."""
    p = table(spark, sf, "part")
    word = lambda text, share: F.struct(text.alias("text"), (share % 100 / 100.0).alias("confidence"))
    words = F.array(word(F.col("p_brand"), F.col("p_partkey") * 37), word(F.substring("p_name", 1, 4), F.col("p_partkey") * 61), word(F.when(F.col("p_partkey") % 5 == 0, "-- .").otherwise("7"), F.col("p_partkey") * 13 + 50))
    return p.select("p_partkey", F.concat(F.lit("cam"), (F.col("p_size") % 4).cast("string")).alias("camera"), words.alias("words"))


R = """r AS (SELECT p_partkey, 'cam' || (p_size % 4) AS camera, [struct_pack(t := p_brand, c := (p_partkey * 37 % 100) / 100.0::DOUBLE), struct_pack(t := substr(p_name, 1, 4), c := (p_partkey * 61 % 100) / 100.0::DOUBLE),
 struct_pack(t := CASE WHEN p_partkey % 5 = 0 THEN '-- .' ELSE '7' END, c := ((p_partkey * 13 + 50) % 100) / 100.0::DOUBLE)] AS words FROM part),
 a AS (SELECT p_partkey, camera, list_filter(list_transform(words, lambda w: struct_pack(t := regexp_replace(upper(w.t), '[^A-Z0-9]', '', 'g'), raw := w.t, c := w.c)), lambda w: w.t <> '' AND w.c > 0.3::DOUBLE) AS ok FROM r),
 b AS (SELECT p_partkey, camera, array_to_string(list_transform(ok, lambda w: w.t), '') AS plate_text, list_sum(list_transform(ok, lambda w: w.c)) / nullif(len(ok), 0) AS plate_confidence, array_to_string(list_transform(ok, lambda w: w.raw), ' ') AS raw_text FROM a)"""


def plates_read(spark, sf):
    """Accepted words of each plate put together; unsure plates stay, without a text."""
    d = _words(spark, sf).withColumn("ok", accepted_words(F.col("words")))
    d = d.select("p_partkey", "camera", *combined(F.col("ok")))
    return d.select("p_partkey", "camera", sure_text(F.col("plate_text"), F.col("plate_confidence"), 0.5).alias("plate_text"), rounded("plate_confidence", 6).alias("plate_confidence"), "raw_text")


def plate_rate(spark, sf):
    return success_rate(plates_read(spark, sf), "camera", "plate_text").withColumn("rate", rounded("rate", 6))


def picture_likeness(spark, sf):
    """Structural similarity of each order's picture (quantities) and the next one (prices), from their statistics."""
    g = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") * 5).alias("a"), (F.col("l_extendedprice") / 500).alias("b")).groupBy("l_orderkey")
    g = g.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("c"))
    return g.select("l_orderkey", rounded(similarity_index(F.col("ma"), F.col("mb"), F.col("va"), F.col("vb"), F.col("c")), 6).alias("ssim"))


def unit_vectors(spark, sf):
    """Vectors that lost their length (times id) brought back to it, by their product with the first of the gallery."""
    g = gallery(spark, sf).withColumn("stretched", F.transform("embedding", lambda x: x * (F.col("vec_id") % 5)))
    first = g.filter("vec_id = 0").select(F.col("embedding").alias("probe"))
    s = g.crossJoin(F.broadcast(first)).withColumn("unit", normalised("stretched"))
    return s.select("vec_id", rounded(dot("unit", "probe"), 5).alias("likeness"), rounded(dot("unit", "unit"), 5).alias("length"))


def crop_plan(spark, sf):
    """Where colours are taken from, how far crops grow, and the place of a plate found in a crop."""
    d = detections(spark, sf)
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    parts = [c.alias(f"{name}_{side}") for name in ("upper", "lower", "vehicle", "hair") for side, c in zip(("x1", "y1", "x2", "y2"), region(box, name), strict=True)]
    crop = padded(box, F.lit(640.0), F.lit(480.0), 10)
    return d.select("event_id", *parts, upscale(F.col("h")).alias("factor"), (crop[0] + 3).alias("plate_x"), (crop[1] + 4).alias("plate_y"))


def class_colours(spark, sf):
    c = table(spark, sf, "events").select(F.col("event_type").alias("class_name")).distinct()
    return c.select("class_name", *[class_rgb(F.col("class_name"))[i].alias(x) for i, x in enumerate("rgb")])


def confidence_bands(spark, sf):
    d = detections(spark, sf)
    return d.groupBy("camera", confidence_band(F.col("conf")).alias("band")).agg(F.count("*").alias("n"))


def frame_times(spark, sf):
    """Frame numbers of a model or from the place in the file, and their seconds; a rate of 0 has none."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    stored = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_orderkey"))
    index = frame_index(stored, F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("int") - 3)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", index.cast("long").alias("frame"), rounded(frame_seconds(index, F.floor("l_quantity") % 4), 6).alias("seconds"))


def clock_texts(spark, sf):
    """Times on cameras' clocks, half of which have a start."""
    d = detections(spark, sf).withColumn("start", F.when(F.col("track_id") % 2 == 0, F.concat_ws(":", F.lpad((F.col("track_id") % 24).cast("string"), 2, "0"), F.lit("30"), F.lit("15"))))
    return d.select("event_id", clock_from(F.col("start"), F.col("ts_sec")).alias("clock"))


def clock_gaps(spark, sf):
    """Seconds between the last sighting on one camera and the first on the next, each by its own clock."""
    t = tracklets(detections(spark, sf)).withColumn("who", F.floor(F.col("track_id") / 4)).withColumn("start", (F.substring("camera", 4, 1).cast("long") * 977).cast("double"))
    w = W.partitionBy("who").orderBy("first_ts", "track_id", "segment")
    t = t.withColumn("was", F.lag("camera").over(w)).withColumn("left", F.lag(F.col("last_ts") + F.col("start")).over(w))
    return t.filter("was <> camera").select("who", "track_id", "segment", "was", "camera", rounded(F.col("first_ts") + F.col("start") - F.col("left"), 6).alias("gap"))


def timeline_rows(spark, sf):
    """On camera, off camera and in transit, by identity."""
    t = tracklets(detections(spark, sf)).withColumn("who", F.floor(F.col("track_id") / 4)).select("who", "camera", "first_ts", "last_ts")
    return timeline(t, "who").select("who", "kind", "place", rounded("begin", 6).alias("begin"), rounded("lasts", 6).alias("lasts"))


def presence(spark, sf):
    """First and last seen and time on camera by identity; off-camera time of persons alone."""
    t = tracklets(detections(spark, sf)).withColumn("who", F.floor(F.col("track_id") / 4))
    w = W.partitionBy("who", "entity_type").orderBy("first_ts", "last_ts", "camera")
    gap = F.col("first_ts") - F.lag("last_ts").over(w)
    g = t.withColumn("gap", F.greatest(gap, F.lit(0.0))).groupBy("who", "entity_type").agg(rounded(F.min("first_ts"), 6).alias("first_seen"), rounded(F.max("last_ts"), 6).alias("last_seen"), rounded(F.sum(F.col("last_ts") - F.col("first_ts")), 4).alias("on_secs"), rounded(F.coalesce(F.sum("gap"), F.lit(0.0)), 4).alias("off"))
    return g.select("who", "entity_type", "first_seen", "last_seen", "on_secs", F.when(F.col("entity_type") == "vehicle", "-").otherwise(rounded("off", 2).cast("decimal(18,2)").cast("string")).alias("off_secs"))


def size_split(spark, sf):
    """Tracks cut where their boxes change size, with new numbers for the later parts."""
    return split_at_break(detections(spark, sf)).groupBy("camera", "track_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n"))


def ordering_customers(spark, sf):
    """Customers with a large order: the semi join."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_nationkey")


def sighting_links(spark, sf):
    """Journeys with the names of both ends: a person must be known, a vehicle may be missing."""
    o, c, p = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").filter("c_custkey % 4 <> 0"), table(spark, sf, "part").filter("p_partkey % 3 <> 0")
    j = o.join(c.select("c_custkey", "c_name"), o.o_custkey == F.col("c_custkey")).withColumn("part", F.col("o_orderkey") % 200)
    return j.join(p.select("p_partkey", "p_name"), F.col("part") == F.col("p_partkey"), "left").select("o_orderkey", "c_name", F.coalesce("p_name", F.lit("unknown")).alias("p_name"))


def signed_nearest(spark, sf):
    """For each vehicle event and person the nearest sighting, departures counted from its end and arrivals to its start, at most an hour away."""
    t = tracklets(detections(spark, sf))
    v = t.filter("entity_type = 'vehicle'").select("camera", F.col("track_id").alias("vehicle"), F.col("segment").alias("v_segment"), F.inline(F.array(F.struct(F.lit("arrival").alias("event"), F.col("first_ts").alias("at")), F.struct(F.lit("departure").alias("event"), F.col("last_ts").alias("at")))))
    p = t.filter("entity_type = 'person'").select("camera", F.col("track_id").alias("person"), F.col("segment").alias("p_segment"), F.inline(F.array(F.struct(F.lit("arrival").alias("event"), F.col("first_ts").alias("edge")), F.struct(F.lit("departure").alias("event"), F.col("last_ts").alias("edge")))))
    # Of a person's sightings, each is the nearest from halfway to the one before it to halfway to the one after, so no choice among pairs is left to make.
    own = W.partitionBy("camera", "person", "event").orderBy("edge")
    p = p.groupBy("camera", "person", "event", "edge").agg(F.min("p_segment").alias("p_segment")).withColumn("before", F.lag("edge").over(own)).withColumn("after", F.lead("edge").over(own))
    v, p = v.withColumn("bucket", F.floor(F.col("at") / 3600)), p.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("edge") / 3600) + i for i in (-1, 0, 1)])))
    gap = F.when(F.col("event") == "departure", F.col("at") - F.col("edge")).otherwise(F.col("edge") - F.col("at"))
    v, p = (x.repartition(lanes(t), "camera", "event", "bucket") for x in (v, p))
    j = v.join(p, ["camera", "event", "bucket"]).withColumn("gap", gap).filter(F.abs("gap") <= 3600)
    off = lambda c: F.abs(F.col("at") - F.col(c))
    nearest = (F.col("before").isNull() | (off("before") > F.abs("gap"))) & (F.col("after").isNull() | (off("after") >= F.abs("gap")))
    return j.filter(nearest).select("camera", "vehicle", "v_segment", "event", "person", "p_segment", rounded("gap", 6).alias("gap"))


def made_times(spark, sf):
    """When recordings were made: the first of three tags that holds anything; their metadata as JSON and a digest."""
    p = table(spark, sf, "part")
    tags = [F.when(F.col("p_partkey") % 3 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_name")]
    meta = F.to_json(F.struct(F.col("p_size").alias("width"), F.col("p_brand").alias("codec")))
    return p.select("p_partkey", first_filled(*tags).alias("made"), meta.alias("metadata"), F.md5(F.col("p_name").cast("binary")).alias("md5"), F.sha2("p_name", 256).alias("sha256"))


def run_ids(spark, sf):
    """A run's id: twelve characters of a digest that the caller passes in, so that reruns agree."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.substring(F.sha2("c_name", 256), 1, 12).alias("run_id"), F.startswith(F.col("c_mktsegment"), F.lit("unknown")).alias("unknown"))


def no_flags(spark, sf):
    """Risk of every part, those without a flag included: clean and certain."""
    p, l = table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem").filter("l_discount >= 0.1 and l_partkey % 3 <> 0")  # noqa: E741
    f = l.select("l_partkey", F.when(F.col("l_quantity") > 49, "critical").when(F.col("l_quantity") > 40, "warning").otherwise("info").alias("severity"))
    g = f.groupBy("l_partkey").agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w"), F.count("*").alias("flags"))
    g = p.join(g, F.col("p_partkey") == F.col("l_partkey"), "left").fillna(0, ["c", "w", "flags"])
    risk = F.when(F.col("flags") == 0, F.struct(F.lit("clean").alias("r"), F.lit(1.0).alias("s"))).when(F.col("c") >= 2, F.struct(F.lit("high").alias("r"), F.least(0.5 + 0.1 * F.col("c"), F.lit(1.0)).alias("s")))
    risk = risk.when(F.col("c") == 1, F.struct(F.lit("medium").alias("r"), F.lit(0.7).alias("s"))).when(F.col("w") >= 3, F.struct(F.lit("medium").alias("r"), F.lit(0.6).alias("s")))
    risk = risk.when(F.col("w") >= 1, F.struct(F.lit("low").alias("r"), F.lit(0.5).alias("s"))).otherwise(F.struct(F.lit("clean").alias("r"), F.lit(0.9).alias("s")))
    return g.select("p_partkey", "flags", risk["r"].alias("risk"), rounded(risk["s"], 6).alias("confidence"))


_REGION = lambda name, top, bottom, left, right: f"floor(x1 + (x2 - x1) * {left}::DOUBLE)::BIGINT AS {name}_x1, floor(y1 + (y2 - y1) * {top}::DOUBLE)::BIGINT AS {name}_y1, floor(x1 + (x2 - x1) * {right}::DOUBLE)::BIGINT AS {name}_x2, floor(y1 + (y2 - y1) * {bottom}::DOUBLE)::BIGINT AS {name}_y2"
PLANS = {
    "entity_listing": (entity_listing, f"WITH {E} SELECT camera, entity_type, p_partkey, run_id FROM e WHERE camera = 'cam1' AND run_id = 3"),
    "appearance_search": (appearance_search, f"WITH {E} SELECT p_partkey, camera, description FROM e WHERE camera IN ('cam0', 'cam2') AND entity_type = 'person' AND description ILIKE '%_D%tOp%' AND upper_color = 'red'"),
    "camera_paths": (camera_paths, f"WITH {D} SELECT camera, min('/footage/' || camera || '/' || track_id || '.part.mp4') AS path, regexp_extract(min('/footage/' || camera || '/' || track_id || '.part.mp4'), '([^/]*)[.]mp4$', 1) AS label FROM d GROUP BY camera"),
    "frame_lookup": (frame_lookup, f"WITH {D}, w AS (SELECT track_id, min(entity_type) AS entity_type, count(*) AS frames FROM d WHERE camera = 'cam2' GROUP BY track_id) SELECT d.track_id AS entity_id, w.entity_type, frames, frame_idx, event_id, greatest(x1 - 5, 0) AS c0, greatest(y1 - 5, 0) AS c1, least(x2 + 5, 640) AS c2, least(y2 + 5, 480) AS c3 FROM d JOIN w USING (track_id) WHERE camera = 'cam2' AND frame_idx BETWEEN 14000 AND 14400"),
    "least_box": (least_box, f"WITH {D} SELECT camera, entity_type, count(*) AS n FROM d WHERE NOT (h < 50 OR w < 20) GROUP BY ALL"),
    "entity_counts": (entity_counts, f"WITH {D} SELECT camera, count(DISTINCT track_id) FILTER (entity_type = 'person') AS persons, count(DISTINCT track_id) FILTER (entity_type = 'vehicle') AS vehicles FROM d GROUP BY camera"),
    "running_best": (running_best, f"WITH {D}, b AS (SELECT *, max(conf) OVER (PARTITION BY camera, track_id ORDER BY frame_idx, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM d) SELECT event_id, camera, track_id, round(conf, 6) AS conf FROM b WHERE bef IS NULL OR conf > bef"),
    "report_preview": (report_preview, f"WITH {D} SELECT camera, row_number() OVER (PARTITION BY camera ORDER BY frame_idx, event_id)::INTEGER AS place, event_id FROM d QUALIFY place <= 10"),
    "plates_read": (plates_read, f"WITH {R} SELECT p_partkey, camera, CASE WHEN plate_confidence >= 0.5 AND plate_text <> '' THEN plate_text END AS plate_text, round(plate_confidence, 6) AS plate_confidence, coalesce(raw_text, '') AS raw_text FROM b"),
    "plate_rate": (plate_rate, f"WITH {R} SELECT camera, count(*) AS plates, count(*) FILTER (plate_confidence >= 0.5 AND plate_text <> '') AS read, round(count(*) FILTER (plate_confidence >= 0.5 AND plate_text <> '') / count(*)::DOUBLE, 6) AS rate FROM b GROUP BY camera"),
    "picture_likeness": (picture_likeness, "WITH s AS (SELECT l_orderkey, avg(l_quantity * 5) AS ma, avg(l_extendedprice / 500) AS mb, var_pop(l_quantity * 5) AS va, var_pop(l_extendedprice / 500) AS vb, covar_pop(l_quantity * 5, l_extendedprice / 500) AS c FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round((2 * ma * mb + 6.5025::DOUBLE) * (2 * c + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (va + vb + 58.5225::DOUBLE)), 6) AS ssim FROM s"),
    "unit_vectors": (unit_vectors, f"WITH {G} SELECT x.vec_id, CASE WHEN x.vec_id % 5 = 0 THEN 0.0 ELSE round(list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)), 5) END::DOUBLE AS likeness, CASE WHEN x.vec_id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS length FROM g AS x, g AS y WHERE y.vec_id = 0"),
    "crop_plan": (crop_plan, f"WITH {D} SELECT event_id, {_REGION('upper', 0.15, 0.45, 0.25, 0.75)}, {_REGION('lower', 0.5, 0.8, 0.25, 0.75)}, {_REGION('vehicle', 0.25, 0.75, 0.1, 0.9)}, {_REGION('hair', 0.0, 0.15, 0.3, 0.7)}, greatest(1, 200 // h::BIGINT)::INTEGER AS factor, greatest(x1 - 10, 0) + 3 AS plate_x, greatest(y1 - 10, 0) + 4 AS plate_y FROM d"),
    "class_colours": (class_colours, "SELECT event_type AS class_name, ('0x' || substr(md5(event_type), 1, 2))::INTEGER AS r, ('0x' || substr(md5(event_type), 3, 2))::INTEGER AS g, ('0x' || substr(md5(event_type), 5, 2))::INTEGER AS b FROM (SELECT DISTINCT event_type FROM events)"),
    "confidence_bands": (confidence_bands, f"WITH {D} SELECT camera, CASE WHEN conf * 100 >= 60 THEN 'success' WHEN conf * 100 >= 30 THEN 'warning' ELSE 'info' END AS band, count(*) AS n FROM d GROUP BY ALL"),
    "frame_times": (frame_times, "WITH x AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE l_linenumber * greatest(l_quantity::INTEGER - 3, 1) END::BIGINT AS frame FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, frame, round(frame / nullif(floor(l_quantity)::BIGINT % 4, 0)::DOUBLE, 6) AS seconds FROM x"),
    "clock_texts": (clock_texts, f"""WITH {D}, x AS (SELECT event_id, track_id, floor(ts_sec)::BIGINT AS s FROM d), y AS (SELECT event_id, CASE WHEN track_id % 2 = 0 THEN (track_id % 24 * 3600 + 1815 + s) % 86400 ELSE s END AS s FROM x)
 SELECT event_id, CASE WHEN s >= 360000 THEN (s // 3600)::VARCHAR ELSE lpad((s // 3600)::VARCHAR, 2, '0') END || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM y"""),
    "clock_gaps": (clock_gaps, f"""WITH {D}, {T}, x AS (SELECT track_id // 4 AS who, track_id, segment, camera, first_ts + substr(camera, 4, 1)::BIGINT * 977 AS f, lag(camera) OVER w AS was, lag(last_ts + substr(camera, 4, 1)::BIGINT * 977) OVER w AS l FROM t WINDOW w AS (PARTITION BY track_id // 4 ORDER BY first_ts, track_id, segment))
 SELECT who, track_id, segment, was, camera, round(f - l, 6) AS gap FROM x WHERE was <> camera"""),
    "timeline_rows": (timeline_rows, f"""WITH {D}, {T}, x AS (SELECT track_id // 4 AS who, camera, first_ts, last_ts, lag(camera) OVER w AS was, lag(last_ts) OVER w AS until FROM t WINDOW w AS (PARTITION BY track_id // 4 ORDER BY first_ts, last_ts, camera))
 SELECT who, 'on' AS kind, camera AS place, round(first_ts, 6) AS begin, round(last_ts - first_ts, 6) AS lasts FROM x UNION ALL
 SELECT who, CASE WHEN was = camera THEN 'off' ELSE 'transit' END, CASE WHEN was = camera THEN camera ELSE was || ' > ' || camera END, round(until, 6), round(first_ts - until, 6) FROM x WHERE first_ts > until"""),
    "presence": (presence, f"""WITH {D}, {T}, x AS (SELECT track_id // 4 AS who, entity_type, first_ts, last_ts, greatest(first_ts - lag(last_ts) OVER (PARTITION BY track_id // 4, entity_type ORDER BY first_ts, last_ts, camera), 0) AS gap, lag(last_ts) OVER (PARTITION BY track_id // 4, entity_type ORDER BY first_ts, last_ts, camera) AS l FROM t)
 SELECT who, entity_type, round(min(first_ts), 6) AS first_seen, round(max(last_ts), 6) AS last_seen, round(sum(last_ts - first_ts), 4) AS on_secs, CASE WHEN entity_type = 'vehicle' THEN '-' ELSE round(coalesce(sum(CASE WHEN l IS NOT NULL THEN gap ELSE 0 END), 0), 4)::DECIMAL(18,2)::VARCHAR END AS off_secs FROM x GROUP BY who, entity_type"""),
    "size_split": (size_split, f"""WITH {D}, f AS (SELECT camera, track_id, frame_idx, max(w * h) AS a FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER q AS i, count(*) OVER (PARTITION BY camera, track_id) AS n,
 list_sort(list(a) OVER (PARTITION BY camera, track_id ORDER BY frame_idx ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))[8] AS bef, list_sort(list(a) OVER (PARTITION BY camera, track_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))[8] AS aft
 FROM f WINDOW q AS (PARTITION BY camera, track_id ORDER BY frame_idx)), b AS (SELECT camera, track_id, min(frame_idx) AS cut FROM r WHERE i > 15 AND i <= n - 15 AND least(bef, aft) / greatest(bef, aft) < 0.5 GROUP BY ALL),
 k AS (SELECT b.*, (SELECT max(track_id) FROM d WHERE d.camera = b.camera) + 20000 + row_number() OVER (PARTITION BY camera ORDER BY track_id) AS fresh FROM b)
 SELECT camera, CASE WHEN frame_idx >= cut THEN fresh ELSE track_id END AS track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n FROM d LEFT JOIN k USING (camera, track_id) GROUP BY 1, 2"""),
    "ordering_customers": (ordering_customers, "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "sighting_links": (sighting_links, "SELECT o_orderkey, c_name, coalesce(p_name, 'unknown') AS p_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_custkey % 4 <> 0 LEFT JOIN part ON o_orderkey % 200 = p_partkey AND p_partkey % 3 <> 0"),
    "signed_nearest": (signed_nearest, f"""WITH {D}, {T}, v AS (SELECT camera, track_id AS vehicle, segment AS v_segment, unnest(['arrival', 'departure']) AS event, unnest([first_ts, last_ts]) AS moment FROM t WHERE entity_type = 'vehicle'),
 p AS (SELECT camera, track_id AS person, segment AS p_segment, unnest(['arrival', 'departure']) AS event, unnest([first_ts, last_ts]) AS edge FROM t WHERE entity_type = 'person'),
 j AS (SELECT *, CASE WHEN event = 'departure' THEN moment - edge ELSE edge - moment END AS gap FROM v JOIN p USING (camera, event) WHERE abs(moment - edge) <= 3600)
 SELECT camera, vehicle, v_segment, event, person, p_segment, round(gap, 6) AS gap FROM j QUALIFY row_number() OVER (PARTITION BY camera, vehicle, v_segment, event, person ORDER BY abs(gap), edge, p_segment) = 1"""),
    "made_times": (made_times, """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 1 THEN p_brand END, CASE WHEN p_partkey % 2 = 0 THEN p_type END, p_name) AS made, '{"width":' || p_size || ',"codec":"' || p_brand || '"}' AS metadata, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part"""),
    "run_ids": (run_ids, "SELECT c_custkey, substr(sha256(c_name), 1, 12) AS run_id, c_mktsegment LIKE 'unknown%' AS unknown FROM customer"),
    "risk_without_flags": (no_flags, """WITH f AS (SELECT l_partkey, count(*) FILTER (l_quantity > 49) AS c, count(*) FILTER (l_quantity > 40 AND l_quantity <= 49) AS w, count(*) AS n FROM lineitem WHERE l_discount >= 0.1 AND l_partkey % 3 <> 0 GROUP BY 1), g AS (SELECT p_partkey, coalesce(n, 0) AS flags, c, w FROM part LEFT JOIN f ON p_partkey = l_partkey)
 SELECT p_partkey, flags, CASE WHEN flags = 0 THEN 'clean' WHEN c >= 2 THEN 'high' WHEN c = 1 OR w >= 3 THEN 'medium' WHEN w >= 1 THEN 'low' ELSE 'clean' END AS risk,
 round(CASE WHEN flags = 0 THEN 1.0 WHEN c >= 2 THEN least(0.5::DOUBLE + 0.1::DOUBLE * c, 1.0) WHEN c = 1 THEN 0.7 WHEN w >= 3 THEN 0.6 WHEN w >= 1 THEN 0.5 ELSE 0.9 END::DOUBLE, 6) AS confidence FROM g"""),
}
