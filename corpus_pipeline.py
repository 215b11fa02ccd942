"""From raw documents to packed sequences: language, near duplicates, personal data, mixture, packing.

Stages take the columns of ``documents`` and any others, which all but the last return as they are, whatever their names.
Null and empty texts go at the first stage, having no letter; given to a later one they stay, but for the mixture, which takes
rows of no words no times. Repeated rows are near duplicates; without that stage each counts. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sighthound.llm._common import make_room, materialize, put_back
from sighthound.llm.language_id import identify, train
from sighthound.llm.mixing import apply_mix
from sighthound.llm.packing import pieces
from sighthound.llm.pseudonyms import pseudonymise
from sighthound.llm.trie_join import one_of_each

#: Language ID rejects documents without letters and those whose best language has less than this share.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; one without a label gets the predicted language."""
    free, names = make_room(docs, ("lang_pred", "score"))
    kept = identify(free, train(docs), names["text"]).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return put_back(kept, names, {"lang": F.coalesce(F.col(names["lang"]), F.col("lang_pred"))})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of five-word shingles at 0.8: that of the smallest id, rows without one last."""
    return one_of_each(docs, 5, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in place of personal values."""
    free, names = make_room(docs, ["pii_found"])
    done = pseudonymise(free, names["text"])
    return put_back(done, names, {"n_chars": F.char_length(F.col(names["text"])).cast("long")})


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or leave documents so that sources come to their target weights."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the mixture into sequences."""
    return pieces(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: SQL can't express the language model, the pseudonyms and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
