"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.colour import body_build, clothing_group, colour_name
from ..functions.text import clean_plate, clock, duration, rounded
from ..sources.tables import DETECTIONS_SQL as D
from ..sources.tables import detections, table


def hsv(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr("(event_id * 7) % 180").alias("h"), F.expr("(event_id * 13) % 256").alias("s"), F.expr("(event_id * 29) % 256").alias("v"))


def color_name(spark, sf):
    d = hsv(spark, sf).withColumn("colour", colour_name(F.col("h"), F.col("s"), F.col("v")))
    return d.select("event_id", "colour", clothing_group(F.col("colour")).alias("grp"))


def build(spark, sf):
    return detections(spark, sf).select("event_id", body_build(F.col("w"), F.col("h")).alias("build"))


def ocr_clean(spark, sf):
    return table(spark, sf, "part").select("p_partkey", clean_plate(F.col("p_name")).alias("plate"))


def fmt_duration(spark, sf):
    return detections(spark, sf).select("event_id", duration(F.col("ts_sec") / 100).alias("lasted"), clock(F.col("ts_sec")).alias("at"))


def segment_ranges(spark, sf):
    """Byte ranges of about a minute each: whole division, so the rest of the size belongs to no segment."""
    d = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), (F.col("n_chars") / 40.0).alias("secs"))
    d = d.withColumn("n", F.greatest(F.floor(F.col("secs") / 60), F.lit(1))).withColumn("seg", F.floor(F.col("size") / F.col("n")))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return d.select("doc_id", "i", (F.col("i") * F.col("seg")).alias("lo"), F.least((F.col("i") + 1) * F.col("seg"), F.col("size")).alias("hi"))


def area_ratio(spark, sf):
    d = detections(spark, sf)
    return d.select("event_id", rounded(F.col("w") / F.col("h"), 6).alias("aspect"), rounded(F.hypot(F.col("x1") - 300, F.col("y1") - 200), 6).alias("distance"))


COLOUR_SQL = """CASE WHEN v < 55 THEN 'black' WHEN s < 50 AND v < 100 THEN 'dark grey' WHEN s < 50 AND v < 200 THEN 'grey' WHEN s < 50 THEN 'white' WHEN s < 140 AND h BETWEEN 85 AND 130 AND v < 140 THEN 'grey'
 WHEN v > 200 AND s < 75 THEN 'white' WHEN h BETWEEN 20 AND 65 AND v BETWEEN 40 AND 200 THEN CASE WHEN h >= 35 THEN 'green' ELSE 'olive' END WHEN h BETWEEN 8 AND 22 AND v BETWEEN 40 AND 160 THEN 'brown'
 WHEN h BETWEEN 15 AND 30 AND s < 80 AND v BETWEEN 150 AND 235 THEN 'beige' WHEN (h <= 10 OR h >= 170) AND s >= 70 AND v >= 40 THEN 'red' WHEN h BETWEEN 11 AND 25 AND s >= 70 AND v >= 50 THEN 'orange'
 WHEN h BETWEEN 26 AND 34 AND s >= 70 AND v >= 50 THEN 'yellow' WHEN h BETWEEN 35 AND 85 AND s >= 60 AND v >= 40 THEN 'green' WHEN h BETWEEN 86 AND 130 AND s >= 35 AND v >= 25 THEN 'blue'
 WHEN h BETWEEN 131 AND 160 AND s >= 50 AND v >= 40 THEN 'purple' WHEN h BETWEEN 161 AND 169 AND s >= 30 AND v >= 50 THEN 'pink' ELSE 'unknown' END"""
PLANS = {
    "color_name": (color_name, f"""WITH e AS (SELECT event_id, (event_id * 7) % 180 AS h, (event_id * 13) % 256 AS s, (event_id * 29) % 256 AS v FROM events), c AS (SELECT event_id, {COLOUR_SQL} AS colour FROM e)
 SELECT event_id, colour, CASE WHEN colour IN ('black', 'dark grey') THEN 'dark' WHEN colour IN ('grey', 'light grey') THEN 'grey' WHEN colour IN ('white', 'light') THEN 'light' ELSE colour END AS grp FROM c"""),
    "body_build": (build, f"WITH {D} SELECT event_id, CASE WHEN h < 10 THEN 'unknown' WHEN w / h < 0.40 THEN 'slim' WHEN w / h > 0.55 THEN 'stocky' ELSE 'medium' END AS build FROM d"),
    "ocr_clean": (ocr_clean, r"SELECT p_partkey, upper(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS plate FROM part"),
    "fmt_duration": (fmt_duration, f"""WITH {D}, x AS (SELECT event_id, ts_sec, ts_sec / 100 AS q, floor(ts_sec / 100)::BIGINT AS f, floor(ts_sec)::BIGINT % 86400 AS c FROM d)
 SELECT event_id, CASE WHEN q < 60 THEN round_even(q, 0)::BIGINT || 's' WHEN q < 3600 THEN (f // 60) || 'm ' || (f % 60) || 's' ELSE (f // 3600) || 'h ' || (f % 3600 // 60) || 'm' END AS lasted,
 lpad((c // 3600)::VARCHAR, 2, '0') || ':' || lpad((c % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((c % 60)::VARCHAR, 2, '0') AS at FROM x"""),
    "segment_ranges": (segment_ranges, """WITH x AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS size, greatest(floor(n_chars / 40.0::DOUBLE / 60)::BIGINT, 1) AS n FROM documents), y AS (SELECT doc_id, size, size // n AS seg, unnest(range(n)) AS i FROM x)
 SELECT doc_id, i, i * seg AS lo, least((i + 1) * seg, size) AS hi FROM y"""),
    "area_ratio": (area_ratio, f"WITH {D} SELECT event_id, round(w / h, 6) AS aspect, round(sqrt((x1 - 300) * (x1 - 300) + (y1 - 200) * (y1 - 200)), 6) AS distance FROM d"),
}
