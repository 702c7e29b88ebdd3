"""Visual analogy problems: problems, figures and analogies as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIGURES = {
    "2x2": ("A", "B", "C", "1", "2", "3", "4", "5", "6"),
    "3x3": ("A", "B", "C", "D", "E", "F", "G", "H", "1", "2", "3", "4", "5", "6", "7", "8"),
}


def from_images(images: DataFrame, ptype: str = "2x2") -> tuple[DataFrame, DataFrame]:
    """Problems of neighbouring images: (problems, figures); incomplete ones are dropped."""
    names = FIGURES[ptype]
    n = len(names)
    figures = images.select(
        F.floor(F.col("img_id") / n).alias("problem_id"),
        F.array(*[F.lit(x) for x in names])[(F.col("img_id") % n).cast("int")].alias("figure"),
        "img_id",
    )
    problems = figures.groupBy("problem_id").agg(F.count("*").alias("k")).where(F.col("k") == n)
    problems = problems.select("problem_id", F.concat(F.lit("problem "), F.col("problem_id")).alias("name"), F.lit(ptype).alias("ptype"), F.lit("derived").alias("set_name"), F.lit(True).alias("has_visual"), F.lit(False).alias("has_verbal"))
    return problems, figures.join(problems.select("problem_id"), "problem_id", "left_semi")


def analogies(problems: DataFrame, texts: list[str]) -> DataFrame:
    """(problem_id, analogy): each text, like ``A:B::C:1``, for every problem."""
    return problems.select("problem_id", F.explode(F.array(*[F.lit(t) for t in texts])).alias("analogy"))
