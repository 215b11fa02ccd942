"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, root being the least node that it reaches.

    Alternates large and small stars: every round hangs neighbours on the least one that they see, so the number of rounds
    grows with the logarithm of the longest path. Only links shuffle, least values are combined before they do, and each
    round is written to the shared folder.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first())
        if state == seen:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = state
    raise RuntimeError(f"no fixed point after {rounds} rounds")
