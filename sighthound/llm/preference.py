"""Preference formatting of chosen and rejected conversations (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import make_room, quoted

OUT = ("prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")
END = "\n<|end|>\n"


def _head(role: str) -> str:
    return f"concat('<|', {role}, '|>\\n')"


def _render(turns: str) -> Column:
    return F.expr(f"array_join(transform({turns}, t -> concat({_head('t.role')}, t.text, '\\n<|end|>\\n')), '')")


def _mask(turns: str) -> Column:
    """Run lengths in characters, flag:length: 1 where a model is trained (text and end of an assistant's turn)."""
    head, body = f"char_length({_head('t.role')})", f"char_length(t.text) + {len(END)}"
    return F.expr(f"array_join(transform({turns}, t -> if(t.role = 'assistant', concat('0:', {head}, ',1:', {body}), concat('0:', {head} + {body}))), ',')")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Turn pairs of conversations (arrays of struct role, text) into a prompt and two masked completions.

    The prompt is the longest prefix of turns that both share, rendered once; the completions are what follows, each
    with the run lengths of its loss mask. Adds ``prompt_turns, prompt, chosen_text, chosen_mask, rejected_text,
    rejected_mask``; columns of the input with these names get ``input_`` before theirs. A null array counts as no turns,
    a null turn as one of nulls, null roles as ``unknown``, null texts as empty; equal conversations have empty completions,
    and conversations that differ in the first turn an empty prompt. Repeated pairs come out as often as they go in, an
    empty table gives no rows. A conversation is one value, so its length is bounded by what a row can hold.
    """
    pairs, names = make_room(pairs, OUT)
    others = list(pairs.columns)
    clean = lambda c: f"transform(coalesce({quoted(names[c])}, array()), t -> struct(coalesce(t.role, 'unknown') as role, coalesce(t.text, '') as text))"
    df = pairs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.expr(clean(chosen)).alias("a"), F.expr(clean(rejected)).alias("b"))
    same = "zip_with(slice(a, 1, n), slice(b, 1, n), (x, y) -> x = y)"
    df = df.withColumn("n", F.expr("cast(least(size(a), size(b)) as int)"))
    df = df.withColumn("prompt_turns", F.expr(f"cast(coalesce(nullif(array_position({same}, false), 0) - 1, n) as int)"))
    rest = lambda c: F.expr(f"slice({c}, prompt_turns + 1, size({c}))")
    df = df.select("row", "prompt_turns", F.expr("slice(a, 1, prompt_turns)").alias("p"), rest("a").alias("c"), rest("b").alias("r"))
    new = [_render("p").alias("prompt"), _render("c").alias("chosen_text"), _mask("c").alias("chosen_mask"), _render("r").alias("rejected_text"), _mask("r").alias("rejected_mask")]
    return df.select(*[F.col("row")[c].alias(c) for c in others], "prompt_turns", *new)


def forks(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn. Rejected forks from it: it keeps the first ``conv_id mod turns``
    turns, so pairs part at any depth, and goes on as its sibling does from there (conv_id with its lowest bit flipped, up
    to its own last assistant turn). Where the sibling has the same turns, or none, they share more or rejected is shorter.

    Conversations without an assistant turn give no pair; rows without conv_id belong to no conversation. Turns of one
    number are ordered by role and text, with null turns first, null roles as ``unknown`` and null texts as empty; repeated
    rows are repeated turns. One exchange brings the turns of two siblings together.
    """
    turn = F.struct(F.col("conv_id").cast("long").alias("id"), F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = conversations.filter("conv_id is not null").groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    last = "aggregate(transform({0}, (t, i) -> if(t.role = 'assistant', i + 1, 0)), 0, (a, x) -> greatest(a, x))"
    own = lambda k: f"transform(filter(turns, t -> t.id = 2 * pair + {k}), t -> struct(t.role as role, t.text as text))"
    both = both.select("pair", F.expr(own(0)).alias("a"), F.expr(own(1)).alias("b"))
    both = both.select("pair", *[F.expr(f"slice({c}, 1, {last.format(c)})").alias(c) for c in "ab"])
    sides = both.select(F.inline(F.expr("array(struct(2 * pair as conv_id, a as chosen, b as other), struct(2 * pair + 1 as conv_id, b as chosen, a as other))"))).filter("size(chosen) > 0")
    depth = "cast(pmod(conv_id, size(chosen)) as int)"
    return sides.select("conv_id", "chosen", F.expr(f"concat(slice(chosen, 1, {depth}), slice(other, {depth} + 1, size(other)))").alias("rejected"))


def op4_preference_format(spark, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: prompt rendered once, completions with masks."""
    df = format_preferences(forks(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return df.select("conv_id", "prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")


OP4_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t),
 l AS (SELECT conv_id, max(n) AS last FROM r WHERE role = 'assistant' GROUP BY conv_id),
 c AS (SELECT r.conv_id, n, role, text, last, ((r.conv_id % last) + last) % last AS depth FROM r JOIN l USING (conv_id) WHERE n <= last),
 x AS (SELECT conv_id, n, role, text FROM c WHERE n <= depth UNION ALL
       SELECT m.conv_id, c.n, c.role, c.text FROM c JOIN (SELECT DISTINCT conv_id, depth FROM c) AS m ON c.conv_id = xor(m.conv_id, 1::BIGINT) AND c.n > m.depth),
 p AS (SELECT coalesce(c.conv_id, x.conv_id) AS conv_id, coalesce(c.n, x.n) AS n, c.role AS c_role, c.text AS c_text, x.role AS x_role, x.text AS x_text,
       coalesce(c.role = x.role AND c.text = x.text, false) AS same FROM c FULL JOIN x ON c.conv_id = x.conv_id AND c.n = x.n),
 q AS (SELECT *, coalesce(min(n) FILTER (NOT same) OVER (PARTITION BY conv_id) - 1, count(*) OVER (PARTITION BY conv_id)) AS shared FROM p),
 z AS (SELECT conv_id, n, shared, '<|' || c_role || '|>' || chr(10) AS c_head, c_text || chr(10) || '<|end|>' || chr(10) AS c_body, c_role,
       '<|' || x_role || '|>' || chr(10) AS x_head, x_text || chr(10) || '<|end|>' || chr(10) AS x_body, x_role FROM q)
SELECT conv_id, max(shared)::INTEGER AS prompt_turns, coalesce(string_agg(c_head || c_body, '' ORDER BY n) FILTER (n <= shared), '') AS prompt,
 coalesce(string_agg(c_head || c_body, '' ORDER BY n) FILTER (n > shared AND c_role IS NOT NULL), '') AS chosen_text,
 coalesce(string_agg(CASE WHEN c_role = 'assistant' THEN '0:' || length(c_head) || ',1:' || length(c_body) ELSE '0:' || (length(c_head) + length(c_body)) END, ',' ORDER BY n) FILTER (n > shared AND c_role IS NOT NULL), '') AS chosen_mask,
 coalesce(string_agg(x_head || x_body, '' ORDER BY n) FILTER (n > shared AND x_role IS NOT NULL), '') AS rejected_text,
 coalesce(string_agg(CASE WHEN x_role = 'assistant' THEN '0:' || length(x_head) || ',1:' || length(x_body) ELSE '0:' || (length(x_head) + length(x_body)) END, ',' ORDER BY n) FILTER (n > shared AND x_role IS NOT NULL), '') AS rejected_mask
FROM z GROUP BY conv_id
"""
