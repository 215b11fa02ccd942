"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch handed to Python: keeps a batch of long texts small.
ARROW_ROWS = 256


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer file; operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset (tests, one machine) a local folder serves; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "sighthound-shared")


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, gives sizes.

    The folder goes when the driver ends, since a result that is still to be read may need it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default, unless the session already asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(text):
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def schema_of(df: DataFrame, more: str = "") -> T.StructType:
    """A copy of the schema, with the columns of a DDL string behind it."""
    return T.StructType([*df.schema.fields, *(T.StructType.fromDDL(more).fields if more else [])])


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with ``input_`` before it until no name of ``taken`` equals it, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"input_{name}"
    return name


def make_room(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """Keep ``names`` free for an operator's results: columns of the input that have one of them get ``input_`` before it.

    This is the rule of all operators here. Returns the table and the new name of every column.
    """
    wanted, out = {n.lower() for n in names}, {}
    for c in df.columns:
        out[c] = free_name([*(x for x in df.columns if x != c), *out.values(), *names], c) if c.lower() in wanted else c
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in out.items()]), out


def quoted(name: str) -> str:
    """A column's name for an expression, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def put_back(df: DataFrame, names: dict[str, str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The input's columns under their own names again (``names`` of ``make_room``), some of them computed anew."""
    changed = changed or {}
    return df.select(*[changed.get(c, F.col(quoted(n))).alias(c) for c, n in names.items()])
