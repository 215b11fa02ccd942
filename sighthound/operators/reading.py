"""What a reader of plates says: which words count, what they make together, how often it succeeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_plate


def accepted_words(words: Column, least: float = 0.3) -> Column:
    """Words ``(text, confidence)`` whose cleaned text isn't empty and whose confidence is above ``least``."""
    return F.filter(F.transform(words, lambda w: F.struct(clean_plate(w["text"]).alias("text"), w["text"].alias("raw"), w["confidence"].alias("confidence"))), lambda w: (w["text"] != "") & (w["confidence"] > least))


def combined(words: Column) -> list[Column]:
    """Text of all words together, their mean confidence, and what was read, with blanks between."""
    n = F.size(words)
    mean = F.try_divide(F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]), n)
    return [F.array_join(F.transform(words, lambda w: w["text"]), "").alias("plate_text"), mean.alias("plate_confidence"), F.array_join(F.transform(words, lambda w: w["raw"]), " ").alias("raw_text")]


def sure_text(text: Column, confidence: Column, least: float) -> Column:
    """The text where the reader is sure enough and read something, else null; the row stays."""
    return F.when((confidence >= least) & (text != ""), text)


def success_rate(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Plates, those read, and their share, by group."""
    return rows.groupBy(by).agg(F.count("*").alias("plates"), F.count(text).alias("read")).withColumn("rate", F.try_divide(F.col("read").cast("double"), F.col("plates").cast("double")))
