"""Homomorphic multiset fingerprints of documents (DataFrame functions only).

A fingerprint is an array of longs: the number of paragraphs; four lanes that add 62-bit hashes of the paragraphs modulo
2^62, for equality; and sixty longs that pack two lanes each, which add one bit of a paragraph's hash modulo 2^30, for
likeness: more than the paragraphs that a text of less than 2^31 bytes can have. Adding is commutative and can be undone,
so paragraphs may come in any order and be inserted or deleted later. The likeness of unrelated texts is 0 give or take
0.09 (one over the square root of the 120 lanes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, free_name, make_room, quoted

#: A paragraph here: a line, cut further after a sentence's end.
PARAGRAPH_END = r"\n+|(?<=[.!?])\s+"
#: Lanes for equality, longs with lanes for likeness that a hash fills, hashes that do so, and bits of a lane.
STRONG, PACKED, HASHES, LANE_BITS = 4, 30, 2, 30
MASK = (1 << 62) - 1
#: One bit, all bits and the carry of each of the two packed lanes, which stand 31 bits apart.
ONES = 1 + (1 << LANE_BITS + 1)
LANES = ONES * ((1 << LANE_BITS) - 1)
CARRY = ONES << LANE_BITS


def paragraphs(text: Column) -> Column:
    return F.filter(F.coalesce(F.split(text, PARAGRAPH_END), F.array().cast("array<string>")), lambda x: x != "")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of ``text`` as ``out``; a null or empty text has no paragraphs and the fingerprint of zeros.

    A column of the input that is called ``out`` gets ``input_`` before its name. Rows keep to themselves, so repeated rows
    and ties need no rule.
    """
    df, names = make_room(df, [out])
    units = free_name([*df.columns, out], "units")
    bits = [free_name([*df.columns, out], f"bits{i}") for i in range(HASHES)]
    df = df.withColumn(units, paragraphs(F.col(quoted(names[text]))))
    low = (1 << PACKED) - 1  # bits 0 to 29 of the hash go to the first lanes, 30 to 59 one place up to the second
    for i, b in enumerate(bits):
        df = df.withColumn(b, F.expr(f"transform(transform({units}, x -> xxhash64({STRONG + i}, x)), h -> (h & {low}L) | shiftleft(h & {low << PACKED}L, 1))"))
    strong = [f"aggregate({units}, 0L, (a, x) -> (a + (xxhash64({i}, x) & {MASK}L)) & {MASK}L)" for i in range(STRONG)]
    packed = [f"aggregate({b}, 0L, (a, h) -> (a + (shiftrightunsigned(h, {j}) & {ONES}L)) & {LANES}L)" for b in bits for j in range(PACKED)]
    return df.withColumn(out, F.expr(f"array(cast(size({units}) as bigint), {', '.join(strong + packed)})")).drop(units, *bits)


def add(a: str, b: str) -> Column:
    """Fingerprint of the texts of ``a`` and ``b`` together (column names)."""
    return F.expr(f"transform({a}, (x, i) -> case when i = 0 then x + {b}[i] when i <= {STRONG} then (x + {b}[i]) & {MASK}L else (x + {b}[i]) & {LANES}L end)")


def subtract(a: str, b: str) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.expr(f"transform({a}, (x, i) -> case when i = 0 then x - {b}[i] when i <= {STRONG} then (x - {b}[i]) & {MASK}L else ((x | {CARRY}L) - {b}[i]) & {LANES}L end)")


def as_text(fp: str) -> Column:
    return F.expr(f"array_join(transform({fp}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """How alike two fingerprints are, 0 to 1 (0 where one has no paragraphs and the other has): twice the inner product over the squares' sum, of the lanes as signed sums.

    A packed lane holds how many paragraphs have a bit set, modulo 2^30; with the number of paragraphs it gives a sum of
    signs, whose products estimate how many paragraphs two texts share. Equal fingerprints give exactly 1.
    """
    size = 1 << LANE_BITS

    def signed(x: str, n: str) -> str:
        return f"cast(2 * ({x} + {size}L * cast(round(({n} / 2.0D - {x}) / {size}.0D) as bigint)) - {n} as double)"

    lanes = f"sequence(0, {2 * HASHES * PACKED - 1})"
    get = lambda v: f"shiftrightunsigned({v}[{STRONG + 1} + cast(i div 2 as int)], {LANE_BITS + 1} * cast(i % 2 as int)) & {size - 1}L"
    pairs = f"transform(transform({lanes}, i -> struct({get(a)} as p, {get(b)} as q)), z -> struct({signed('z.p', a + '[0]')} as x, {signed('z.q', b + '[0]')} as y))"
    sums = f"aggregate({pairs}, struct(0.0D as d, 0.0D as n), (s, z) -> struct(s.d + z.x * z.y as d, s.n + z.x * z.x + z.y * z.y as n), s -> 2 * s.d / nullif(s.n, 0.0D))"
    return F.expr(f"case when {a} = {b} then 1.0D else coalesce(greatest(0.0D, least(1.0D, {sums})), 0.0D) end")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the following row in ascending ``key``; after the last comes the first.

    Rows of one key are ordered by a hash of those ``columns`` that ``docs`` has, null keys come first; rows alike in all of these are
    interchangeable. Rows go to buckets of about equal size between quantiles of the key (as many as four times the shuffle
    partitions); a key that fills several of them is split by the hash. Each bucket is ordered by itself, and one row, the
    first of each bucket, also visits the bucket before. One exchange moves the rows. ``prepare`` adds columns, which ``columns``
    may name too, just before that exchange, so the passes that place the rows don't compute them. A column ``next`` of the input gets
    ``input_`` before its name; an empty table stays empty.
    """
    spark = docs.sparkSession
    docs, names = make_room(docs, ["next"])
    others = list(docs.columns)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = F.coalesce(F.col(quoted(names[key])).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), low.alias("k"), F.xxhash64(*[F.col(quoted(names[c])) for c in columns if c in names]).alias("tie"))
    found = docs.select(low.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    cuts, shares = sorted(set(found or [])), {}
    for x in found or []:
        shares[x] = shares.get(x, 0) + 1
    steps = max(1, len(cuts).bit_length() + 1)
    mid = "cast((s.lo + s.hi) div 2 as int)"
    find = f"aggregate(sequence(1, {steps}), struct(0 as lo, {len(cuts)} as hi), (s, i) -> case when s.lo >= s.hi then s when element_at(cuts, {mid} + 1) <= k then struct({mid} + 1 as lo, s.hi as hi) else struct(s.lo as lo, {mid} as hi) end, s -> s.lo)"
    table = F.array(*[F.lit(x).cast("long") for x in cuts]).cast("array<bigint>")
    # Bucket i holds keys from cut i - 1 on. Its first key gets parts of its own, then all other keys follow in the last part.
    parts = F.array(F.lit(1), *[F.lit(shares[x]) for x in cuts])
    first = F.array(F.lit(None).cast("long"), *[F.lit(x).cast("long") for x in cuts])
    of = lambda a: F.element_at(a, F.col("bucket") + 1)
    spread = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * of(parts)).cast("int")
    dealt = lambda df: df.withColumn("cuts", table).withColumn("bucket", F.expr(find)).drop("cuts").withColumn("part", F.when((F.col("k") == of(first)) & (of(parts) > 1), F.least(spread, of(parts) - 1)).otherwise(of(parts)))
    least = dealt(rows.select("k", "tie")).groupBy("bucket", "part").agg(F.min(F.struct("k", "tie")).alias("m")).collect()  # at most 2 n rows
    places = sorted((r["bucket"], r["part"], r["m"]["k"], r["m"]["tie"]) for r in least)
    prepare = prepare or (lambda df: df)
    if not places:
        return prepare(docs).withColumn("next", F.struct(*[F.col(quoted(names.get(c, c))).alias(c) for c in columns]))
    rows = dealt(rows)
    before = [(*m, *places[i - 1][:2]) for i, m in enumerate(places)]
    long = lambda x: "(-9223372036854775807L - 1L)" if x == -(1 << 63) else f"{x}L"
    visits = spark.sql("select * from values " + ", ".join(f"({b}, {p}, {long(k)}, {long(t)}, {to_b}, {to_p})" for b, p, k, t, to_b, to_p in before) + " as t(bucket, part, k, tie, to_bucket, to_part)")
    ghosts = rows.join(F.broadcast(visits), ["bucket", "part", "k", "tie"]).groupBy("to_bucket", "to_part").agg(F.first("row").alias("row"))
    ghosts = ghosts.select("row", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("tie"), F.col("to_bucket").alias("bucket"), F.col("to_part").alias("part"), F.lit(1).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    place = free_name([*others, *columns], "place")
    both = prepare(both.select(*[F.col("row")[c].alias(c) for c in others], F.struct("bucket", "part", "k", "tie", "ghost").alias(place)))
    others = [c for c in both.columns if c != place]
    both = both.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col(place)["bucket"].alias("bucket"), F.col(place)["part"].alias("part"), F.col(place)["k"].alias("k"), F.col(place)["tie"].alias("tie"), F.col(place)["ghost"].alias("ghost"))
    # The whole row is led, not some of its columns: these would travel beside it.
    both = both.withColumn("following", F.lead("row").over(W.partitionBy("bucket", "part").orderBy("ghost", "k", "tie")))
    return both.filter("ghost = 0").select(*[F.col("row")[c].alias(c) for c in others], F.struct(*[F.col("following")[names.get(c, c)].alias(c) for c in columns]).alias("next"))


def op6_multiset_hash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likeness to the edited text and the next document."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs, ["text", "fp"], prepare=lambda rows: with_fingerprint(rows, "text", "fp"))
    df = df.withColumn("n_chars", F.char_length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    df = df.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {half}), left(next.text, {half}))"))
    df = with_fingerprint(df.select("doc_id", "n_chars", "fp", F.col("next.fp").alias("next_fp"), "edited"), "edited", "efp")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
