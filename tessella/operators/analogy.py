"""Scores of visual analogies such as A:B::C:1, for all problems at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features as feats
from .encode import encode


def relations(analogies: DataFrame) -> DataFrame:
    """(problem_id, analogy, side, relation): premise (1) and conclusion (2) as arrays of two or three figures."""
    parts = analogies.withColumn("_s", F.split("analogy", "::")).where(F.size("_s") == 2)
    sides = parts.select("problem_id", "analogy", F.posexplode("_s").alias("side", "_r"))
    out = sides.select("problem_id", "analogy", (F.col("side") + 1).alias("side"), F.split("_r", ":").alias("relation"))
    return out.withColumn("relation", F.when(F.size("relation").isin(2, 3), F.col("relation")).otherwise(F.raise_error(F.lit("a relation has two or three figures")).cast("array<string>")))


def mutual(rel: DataFrame) -> DataFrame:
    """Adds d1, d2, r: the encodings of each relation: both directions of a pair, six of a triplet."""
    at = lambda i: F.col("relation")[i]
    one = lambda a, b: F.struct(at(a).alias("d1"), F.lit(None).cast("string").alias("d2"), at(b).alias("r"))
    two = lambda a, b, c: F.struct(at(a).alias("d1"), at(b).alias("d2"), at(c).alias("r"))
    pair = F.array(one(0, 1), one(1, 0))
    triplet = F.array(two(0, 1, 2), two(1, 0, 2), two(1, 2, 0), two(2, 1, 0), two(0, 2, 1), two(2, 0, 1))
    return rel.withColumn("_e", F.explode(F.when(F.size("relation") == 2, pair).otherwise(triplet))).select(*rel.columns, "_e.*")


def _found(analogies: DataFrame, figures: DataFrame, images: DataFrame, grids: list[int], **options) -> DataFrame:
    """(problem_id, analogy, side, grid, feature), where a feature may repeat.

    A relation that several analogies share, such as the premise of all
    answers, is encoded once: each directed encoding carries the numbers of the
    analogies and sides that ask for it, and what it says goes to all of them.
    A problem's figures and analogies are few, so both travel as arrays.
    """
    asked = F.collect_list(F.struct("analogy", "side"))
    directed = mutual(relations(analogies)).groupBy("problem_id", "d1", "d2", "r").agg(asked.alias("asked"))
    known = figures.groupBy("problem_id").agg(F.map_from_entries(F.collect_list(F.struct("figure", "img_id"))).alias("of"))
    at = lambda c: F.try_element_at("of", F.col(c))
    full = directed.join(known, "problem_id").select("problem_id", "asked", at("d1").alias("domain1"), F.when(F.col("d2").isNotNull(), at("d2")).alias("domain2"), at("r").alias("range_img"), F.col("d2").isNotNull().alias("two"))
    full = full.where("domain1 is not null and range_img is not null and (domain2 is not null or not two)")
    numbered = full.withColumn("grid", F.explode(F.array(*[F.lit(int(g)) for g in grids])))
    carried = F.struct("problem_id", "asked").alias("carry")
    codes = encode(numbered.select(F.xxhash64("problem_id", "domain1", "domain2", "range_img", "grid").alias("encoding_id"), "domain1", "domain2", "range_img", "grid", carried), images, carry=True, **options)
    return feats.features(codes, "carry", "grid").select("carry.problem_id", F.explode("carry.asked").alias("a"), "grid", "feature").select("problem_id", "a.analogy", "a.side", "grid", "feature")


def mutual_features(analogies: DataFrame, figures: DataFrame, images: DataFrame, grids: list[int], **options) -> DataFrame:
    """(problem_id, analogy, side, grid, feature): distinct features of each side of each analogy."""
    return _found(analogies, figures, images, grids, **options).distinct()


def scores(analogies: DataFrame, figures: DataFrame, images: DataFrame, grid: int, **options) -> DataFrame:
    """(problem_id, analogy, score): similarity of premise and conclusion."""
    return multiscale_scores(analogies, figures, images, [grid], **options)


def multiscale_scores(analogies: DataFrame, figures: DataFrame, images: DataFrame, grids: list[int], **options) -> DataFrame:
    """As :func:`scores`, with the features of several grids in one set each.  Features carry their sides as bits, in one pass."""
    seen = _found(analogies, figures, images, grids, **options).groupBy("problem_id", "analogy", "feature").agg(F.bit_or("side").alias("sides"))
    return feats.shared(seen, "problem_id", "analogy")


def best_answers(scored: DataFrame) -> DataFrame:
    """The analogy with the highest score of each problem, the first by name on ties (an extension)."""
    first = Window.partitionBy("problem_id").orderBy(F.desc("score"), "analogy")
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
