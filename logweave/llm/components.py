"""Connected components by alternating large and small stars, one stored table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweave.operators.joins import join_groups
from logweave.session import store


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over directed rows (u, v): every neighbour is tied to the smallest node around ``u``.

    The large star ties the neighbours above ``u``, the small star those below it and ``u`` itself.
    The minimum is pre-aggregated, so a hub with very many neighbours is combined before the shuffle; and its neighbours
    get it from a broadcast table of hubs, whose number is bounded by their share, instead of meeting in one task.
    """
    around = pairs if large else pairs.where("v < u")
    least = store(around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m")), "stars")
    tied = join_groups(around, least, ["u"], weight="n")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the rows (a, b); the root is the component's smallest node.

    Loops and repeated edges do no harm; no edges give an empty table. The number of rounds
    is logarithmic in the longest path; each writes a table, so a lost executor costs one round at most.
    """
    pairs = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = store(_stars(both, large=True).distinct(), label)
        pairs = store(_stars(wide, large=False).where("u <> v").distinct(), label)
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    root = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(root.select(F.col("root").alias("node"), "root").distinct())
