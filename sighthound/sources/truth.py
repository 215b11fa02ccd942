"""Files of true appearances that people fill in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<description: string, appearances: array<struct<camera: string, frames: array<bigint>>>>"
TRUTH = f"metadata struct<created: string, annotator: string, cameras: array<string>, notes: string>, persons map<string, {ENTITY}>, vehicles map<string, {ENTITY}>"


def template(cameras: list[str], created: str = "") -> str:
    """JSON to fill in: the cameras, and one person as an example."""
    # The file's format and its texts.
    example = {"description": "Describe appearance here", "appearances": [{"camera": cameras[0] if cameras else "camera1", "frames": [0, 100]}]}
    metadata = {"created": created, "annotator": "", "cameras": cameras, "notes": "Fill in person/vehicle appearances with frame ranges"}
    return json.dumps({"metadata": metadata, "persons": {"P1": example}, "vehicles": {}}, indent=2)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``(entity_type, gt_id, camera, f0, f1)``, one row per appearance. Entities without appearances give none."""
    files = spark.read.schema(TRUTH).json(path, multiLine=True)
    kinds = (("person", "persons"), ("vehicle", "vehicles"))
    parts = [files.select(F.lit(kind).alias("entity_type"), F.explode(column).alias("gt_id", "e")) for kind, column in kinds]
    seen = parts[0].unionByName(parts[1]).select("entity_type", "gt_id", F.explode("e.appearances").alias("a"))
    return seen.select("entity_type", "gt_id", "a.camera", F.get("a.frames", F.lit(0)).alias("f0"), F.get("a.frames", F.lit(1)).alias("f1"))


def truth_cameras(spark: SparkSession, path: str) -> list[str]:
    """Cameras that a file names; few, as people list them."""
    return [r[0] for r in spark.read.schema(TRUTH).json(path, multiLine=True).select(F.explode("metadata.cameras")).distinct().orderBy("col").collect()]
