"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, materialize, quoted

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Splits a text before each run of white space that follows a word, so that pieces joined again give a prefix.
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
#: Slices of the ranks, and slices of a slice: sizes are summed per source and slice, and only one slice of a slice per source is ordered.
SLICES = 4096
SEED = 7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row's random number depends on: identifier and text, so that rows without an id or with a common one differ."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of the sources of ``totals(source, source_size)``; one row per source, so its windows are small.

    Weights repeat over the sources in code point order, null last, and share the sum of all sizes. A target stops at
    ``most`` times the source's size; what is over goes to the others by weight until none is above. In the order of
    ``most * size / weight`` the stopped ones come first, so a running sum tells which they are.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    df = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    df = df.withColumn("stopped", F.col("cap") * rest < left * F.col("weight"))
    spent = F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(every)
    share = F.col("weight") * (F.sum("source_size").over(every) - spent).cast("double") / F.nullif(open_weight, F.lit(0)).cast("double")
    return df.select("source", "source_size", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def pareto_mix(rows: DataFrame, keep: list[str], size: str = "size", key: str = "key", source: str = "source", seed: int = SEED, store: bool = False) -> DataFrame:
    """How many words of each row the mix takes.

    Each row gets the certain copies, ``floor(target / source size)``, whole. What the target leaves is a sample of
    fixed size in words: a row's inclusion odds are its source's odds, ``p / (1 - p)`` with p the share that is left, in
    proportion to its size; rows rank by the odds of their random number over these (Pareto order sampling), and the
    lowest ranks are taken until their words fill the rest. The last one is taken in part, so that a source meets its
    target to a word.

    ``v = rank / (1 + rank)`` lies in (0, 1). Sizes are first summed by source and slice of v, then by source and slice of
    the slice in which the target ends; only one slice of a slice is ordered row by row, by rank, key and size, so a hot
    source never meets in one task. Rows of one key and size are alike: they stay together, and it is left open which of them is
    taken.

    The passes before the last read size, key and source alone; with ``store`` they are written first, for ``rows`` that cost
    much to make. Returns ``row`` (struct of ``keep``), ``size``, ``source_size``, ``target``, ``taken``; names in ``rows`` may be any.
    Rows without a source form a source of their own, a null key counts as empty, rows of size 0 or null take 0, repeated
    rows count each, an empty table gives no rows.
    """
    rows = rows.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("row"), F.col(quoted(source)).alias("source"), F.coalesce(F.col(quoted(size)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.col(quoted(key)), F.lit("")).alias("key"))
    narrow = rows.drop("row")
    narrow = materialize(narrow, "mix-sizes") if store else narrow
    totals = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-totals")
    goal = source_targets(totals.select("source", "source_size"))
    goal = goal.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = goal.withColumn("want", F.floor("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("p", F.least(F.coalesce(F.try_divide("want", "source_size"), F.lit(0.0)), F.lit(1 - 1e-12)))
    goal = goal.alias("g").join(totals.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", (F.col("g.source_size") / F.col("rows")).alias("mean"))

    def placed(rows: DataFrame, info: DataFrame) -> DataFrame:
        """Rows with their source's figures and rank; without a rank where nothing is left to take."""
        r = rows.alias("r").join(info.drop("source_size").alias("i"), F.col("r.source").eqNullSafe(F.col("i.source")))
        odds = F.col("p") / (1 - F.col("p")) * F.try_divide("size", "mean")
        u = uniform(F.col("key"), seed)
        r = r.withColumn("rank", F.try_divide(F.try_divide(u, 1 - u), odds)).withColumn("v", F.coalesce(F.col("rank") / (1 + F.col("rank")), F.lit(1.0)))
        fine = F.least(F.floor(F.col("v") * float(SLICES * SLICES)), F.lit(SLICES * SLICES - 1)).cast("long")
        return r.select(*(["row"] if "row" in rows.columns else []), F.col("r.source").alias("source"), "size", "key", "rank", fine.alias("fine"), *[f"i.{c}" for c in info.columns if c not in ("source", "source_size")])

    def ending(sums: DataFrame, info: DataFrame, before: str, cut: str) -> DataFrame:
        """``info`` with the slice in which the target ends, and the words before it; -1 where none does."""
        upto = F.sum("s").over(W.partitionBy("source").orderBy("slice"))
        e = sums.withColumn("upto", upto).alias("a").join(info.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source")))
        start = F.col(before) if before in info.columns else F.lit(0)
        e = e.select(F.col("a.source").alias("source"), "slice", (start + F.col("upto") - F.col("s")).alias("from"), (start + F.col("upto")).alias("to"), "want")
        e = e.filter((F.col("from") < F.col("want")) & (F.col("want") <= F.col("to"))).select("source", F.col("slice").alias(cut), F.col("from").alias("gone"))
        out = info.drop(before).alias("g").join(e.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left")
        return materialize(out.select("g.*", F.coalesce(cut, F.lit(-1).cast("long")).alias(cut), F.coalesce("gone", F.lit(0)).alias(before)), "mix-sources")

    goal = materialize(goal, "mix-goals")
    coarse = F.floor(F.col("fine") / SLICES).cast("long")
    sums = materialize(placed(narrow, goal).groupBy("source", coarse.alias("slice")).agg(F.sum("size").alias("s")), "mix-slices")
    info = ending(sums, goal, "before", "cut")
    sums = materialize(placed(narrow, info).filter(coarse == F.col("cut")).groupBy("source", F.col("fine").alias("slice")).agg(F.sum("size").alias("s")), "mix-slices")
    info = ending(sums, info, "before", "stop")

    r = placed(rows, info)
    order = W.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    last = r.filter("fine = stop").withColumn("gone", F.col("before") + F.sum("size").over(order) - F.col("size"))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("want") - F.col("gone")))).drop("gone")
    rest = r.filter("fine <> stop").withColumn("extra", F.when(F.col("fine") < F.col("stop"), F.col("size")).otherwise(0))
    out = rest.unionByName(last).alias("r").join(totals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    return out.select("row", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, the last copy cut after the words that it takes.

    Keeps the columns of ``docs``, which needs doc_id, text and source; only text and n_chars change. See ``pareto_mix``
    for nulls, ties and repeated rows.
    """
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), word_count(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("source"))
    mixed = pareto_mix(rows, ["row"], seed=seed, store=True).filter("taken > 0").withColumn("row", F.col("row.row"))
    copies = mixed.withColumn("left", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size")), lambda k: F.col("taken") - k * F.col("size"))))
    text = F.when(F.col("left") >= F.col("size"), F.col("row")["text"]).otherwise(F.array_join(F.slice(F.split(F.col("row")["text"], WORD_END), F.lit(1), F.col("left").cast("int")), ""))
    out = copies.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 5, 2, 1: size, source size, target and words taken of each."""
    docs = documents(spark, sf_dir)
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(F.col("doc_id"), F.col("text")).alias("key")), "mix-sizes")
    return pareto_mix(sized, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH e AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
 d AS (SELECT *, (('0x' || substr(md5('7:' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM e),
 t AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
 w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight, 3 * source_size AS cap FROM t),
 s AS (SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) < (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) * weight AS stopped
       FROM w WINDOW b AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT source, source_size, n, CASE WHEN stopped THEN cap::DOUBLE ELSE weight * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ())::DOUBLE
       / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0)::DOUBLE END AS target FROM s),
 h AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM g),
 i AS (SELECT *, floor(target)::BIGINT - whole * source_size AS want, source_size / n::DOUBLE AS mean FROM h),
 p AS (SELECT *, least(coalesce(want / nullif(source_size, 0)::DOUBLE, 0), 1 - 1e-12) AS p FROM i),
 r AS (SELECT d.*, source_size, target, whole, want, u / (1 - u) / nullif(p / (1 - p) * size / nullif(mean, 0), 0) AS rank FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
 j AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS gone FROM r)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN rank IS NULL THEN 0 ELSE greatest(0, least(size, want - gone)) END)::BIGINT AS taken FROM j
"""
