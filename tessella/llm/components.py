"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b): root is the least node.

    Alternating large-star and small-star rounds: every round hangs neighbours
    on the least node seen, so a chain of n nodes needs about log n rounds.
    Minima are pre-aggregated before each shuffle, and only the edges that are
    left travel; each round is saved, so lineage stays short.
    """
    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, old = save(large.where("u <> v"), "cc"), now
        drop_saved(old)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = save(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop_saved(large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state.n:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
