"""Symbolic features of codebooks, and set algebra on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import brightness_bin

# Names of the printed transform fields, in their order.
_NAMES = ("id", "angle", "hf", "vf", "ryx", "rynx", "fill", "unfill")


def variable(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def _transform_fields(ti: Column) -> list[Column]:
    """Fields in their printed order; transform 6 sets ryx and 7 sets rynx, a consistent relabelling that is kept."""
    flag = lambda k: F.when(ti == k, 1).otherwise(0)
    angle = F.when(ti.between(1, 3), ti.cast("int") * 90).otherwise(0)
    return [flag(0), angle, flag(4), flag(5), flag(6), flag(7), flag(8), flag(9)]


def feature_columns() -> dict[str, Column]:
    """The eleven feature strings of a code, by feature name."""
    c = F.col
    tr = [variable(n, v) for n, v in zip(_NAMES, _transform_fields(c("ti")), strict=True)]
    at = [variable(n, c(n)) for n in ("dx", "dy", "sx", "sy")]
    shift = [variable("dx", c("dx") - c("sx")), variable("dy", c("dy") - c("sy"))]
    size = [variable("dx", F.abs(c("dx") - c("sx"))), variable("dy", F.abs(c("dy") - c("sy")))]
    b, x, g = variable("brightness", brightness_bin(c("brightness"))), variable("img_comp", c("comp")), variable("grid_size", c("grid"))
    # The eleven feature names.
    parts = {
        "feat_spec": [*at, *tr, b, x, g],
        "pos_ag": [*shift, *tr, b, x, g],
        "grid_ag": [*at, *tr, b, x],
        "comp_ag": [*at, *tr, b, g],
        "bright_ag": [*at, *tr, x, g],
        "trans_ag": [*at, b, x, g],
        "trans_spec": tr,
        "bright_spec": [b],
        "comp_spec": [x],
        "feat_pos_abs": [*size, *tr, b, x, g],
        "feat_pos_shift": shift,
    }
    return {name: F.concat_ws("_", F.lit(name), *p) for name, p in parts.items()}


def features(codes: DataFrame, *keys: str) -> DataFrame:
    """``keys`` (encoding_id if none) and feature: eleven rows for each code, duplicates kept."""
    keep = keys or ("encoding_id",)
    return codes.select(*keep, F.explode(F.array(*feature_columns().values())).alias("feature"))


def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets).distinct()


def intersection(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), sets).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def similarity(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and score: shared features over all features of each key; both sets empty: no row.

    One pass: each feature of a key is marked with the sides that have it.
    """
    sides = a.select(*keys, "feature", F.lit(1).alias("side")).unionByName(b.select(*keys, "feature", F.lit(2).alias("side")))
    return shared(sides.groupBy(*keys, "feature").agg(F.bit_or("side").alias("sides")), *keys)


def shared(seen: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and score from features marked with the sides (1, 2 or both) that have them."""
    return seen.groupBy(*keys).agg((F.sum((F.col("sides") == 3).cast("long")) / F.count("*")).alias("score"))
