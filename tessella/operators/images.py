"""Reshaping, transforming, composing and filtering images, each row by row.

Whatever a single expression can say stays in the JVM; convolutions go to
numpy in Arrow batches.  No operator here shuffles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks, columns, registry
from .stacks import flat, map_stacks


def tiles(images: DataFrame, g: int, *carry: str) -> DataFrame:
    """(img_id, dx, dy, d): g x g tiles in row-major order; remainders are dropped, dx is the row."""
    at = F.explode(F.sequence(F.lit(0), F.floor(F.col("h") / g) * F.floor(F.col("w") / g) - 1))
    big = images.where((F.col("h") >= g) & (F.col("w") >= g)).withColumn("_t", at)
    per = F.floor(F.col("w") / g)
    put = big.withColumn("dx", (F.floor(F.col("_t") / per) * g).cast("int")).withColumn("dy", ((F.col("_t") % per) * g).cast("int"))
    return put.select("img_id", *carry, "dx", "dy", columns.tile(F.col("pixels"), F.col("w"), F.col("dx"), F.col("dy"), g).alias("d"))


def transformed(tiles_: DataFrame, g: int, last: int = 7) -> DataFrame:
    """Each tile under transforms 0 to ``last``: adds ti and replaces d."""
    versions = F.array(*[F.struct(F.lit(ti).cast("tinyint").alias("ti"), columns.permuted(F.col("d"), ti, g).alias("d")) for ti in range(last + 1)])
    rest = [c for c in tiles_.columns if c != "d"]
    return tiles_.withColumn("_v", F.explode(versions)).select(*rest, "_v.ti", "_v.d")


def reduce(images: DataFrame, f: int) -> DataFrame:
    """Block means; remainders are dropped, pixels are double."""
    t = tiles(images, f, "h", "w")
    t = t.withColumn("m", columns.total(F.col("d")) / (f * f))
    out = t.groupBy("img_id", (F.floor(F.col("h") / f)).cast("int").alias("h"), (F.floor(F.col("w") / f)).cast("int").alias("w"))
    return out.agg(F.transform(F.sort_array(F.collect_list(F.struct("dx", "dy", "m"))), lambda s: s["m"]).alias("pixels"))


def _row(r: Column, left: int | Column, size: int | Column) -> Column:
    return F.slice("pixels", r * F.col("w") + left + 1, size)


def crop(images: DataFrame, height: int, width: int) -> DataFrame:
    """Centred window; of a size larger than the image, the difference is cut off instead."""
    cut = lambda n, to: (F.floor(F.abs(n - to) / 2).cast("int"), (n - F.abs(n - to)).cast("int"))
    (top, h), (left, w) = cut(F.col("h"), height), cut(F.col("w"), width)
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda r: _row(r + top, left, w))
    fits = (h > 0) & (w > 0)
    cut_out = images.withColumn("_cut", F.when(fits, F.flatten(rows)).otherwise(F.array().cast("array<int>")))  # before h and w change
    return cut_out.select("img_id", F.when(fits, h).otherwise(0).alias("h"), F.when(fits, w).otherwise(0).alias("w"), F.col("_cut").alias("pixels"))


def pad(images: DataFrame, height: int, width: int, value: int = 255) -> DataFrame:
    """White margin up to height and width, less than half of it above and left; never crops."""
    h, w = F.greatest(F.col("h"), F.lit(height)), F.greatest(F.col("w"), F.lit(width))
    top, left = F.floor((h - F.col("h")) / 2).cast("int"), F.floor((w - F.col("w")) / 2).cast("int")
    full = lambda n: F.array_repeat(F.lit(value), n)
    right = (w - F.col("w") - left).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda r: F.concat(full(left), _row(r, 0, F.col("w")), full(right)))
    below = (h - F.col("h") - top).cast("int")
    padded = images.withColumn("_pad", F.concat(full((top * w).cast("int")), F.flatten(rows), full((below * w).cast("int"))))  # before h and w change
    return padded.select("img_id", h.cast("int").alias("h"), w.cast("int").alias("w"), F.col("_pad").alias("pixels"))


def resize(images: DataFrame, height: int, width: int) -> DataFrame:
    f = lambda x, hh, ww: {"pixels": flat(blocks.resize(x, (hh, ww)))}
    return map_stacks(images, f, ["pixels"], "pixels array<int>", ["img_id"], (height, width)).select("img_id", F.lit(height).alias("h"), F.lit(width).alias("w"), "pixels")


def translate(images: DataFrame, tx: int, ty: int, constant: int = 0) -> DataFrame:
    """Shift right by tx and down by ty; what is left open is ``constant``."""
    h, w = F.col("h"), F.col("w")

    def shifted(k: Column) -> Column:
        y, x = F.floor(k / w) - ty, k % w - tx
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return F.when(inside, F.get("pixels", (y * w + x).cast("int"))).otherwise(F.lit(constant))

    return images.withColumn("pixels", F.transform(F.sequence(F.lit(0), h * w - 1), shifted))


def fill(px: DataFrame) -> DataFrame:
    """Shape filling on exploded pixels: four running maxima over rows and columns."""
    dark = (F.col("v") < 128).cast("int")
    run = lambda line, at, up: F.max(dark).over(Window.partitionBy("img_id", line).orderBy(F.col(at) if up else F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0))
    sides = F.least(run("y", "x", True), run("y", "x", False), run("x", "y", True), run("x", "y", False))
    return px.select("img_id", "y", "x", F.when(sides == 1, 0).otherwise(255).alias("v"))


_STACKS = {
    "fill": lambda x: blocks.fill(x),
    "unfill": lambda x: blocks.unfill(x),
    "edges": lambda x: blocks.edges(x),
    "identity": lambda x: x,
}


def filtered(images: DataFrame, kind: str) -> DataFrame:
    """``fill``, ``unfill`` or ``edges`` (inverted Sobel strength, double) of every image."""
    f = _STACKS[kind]
    kinds = "array<double>" if kind == "edges" else "array<int>"
    return map_stacks(images, lambda x: {"pixels": flat(f(x))}, ["pixels"], f"pixels {kinds}", ["img_id", "h", "w"])


def convolve(images: DataFrame, kernel: list[list[float]], mode: str = "constant", pad_value: float = 255) -> DataFrame:
    """Same-size correlation with white padding; pixels become double."""
    k = np.array(kernel, float)
    return map_stacks(images, lambda x: {"pixels": flat(blocks.correlate(x, k, mode, pad_value))}, ["pixels"], "pixels array<double>", ["img_id", "h", "w"])


def blur(images: DataFrame, size: int = 3, sigma: float = 3.0) -> DataFrame:
    """Gaussian blur; whole-number pixels stay whole by truncation."""
    return map_stacks(images, lambda x: {"pixels": flat(blocks.blur(x, size, sigma))}, ["pixels"], "pixels array<int>", ["img_id", "h", "w"])


def pairs(images: DataFrame, every: int = 2) -> DataFrame:
    """Neighbours 2k and 2k + 1 as one row: pair_id, h, w, a, b; incomplete pairs are dropped."""
    slots = [F.max(F.when(F.col("img_id") % every == i, F.col("pixels"))).alias(n) for i, n in enumerate("abcdefgh"[:every])]
    out = images.groupBy(F.floor(F.col("img_id") / every).alias("pair_id"), "h", "w").agg(*slots)
    return out.where(" and ".join(f"{n} is not null" for n in "abcdefgh"[:every]))


def composition_name(which: str | int) -> str:
    """Name of a composition by name or number; number 1 is not registered: KeyError."""
    return blocks.COMPOSITIONS[which] if isinstance(which, int) else which


def compose(both: DataFrame, which: str | int) -> DataFrame:
    """Composition of columns a and b of one shape by registered name or number, as pixels."""
    name = composition_name(which)
    keep = [c for c in both.columns if c not in ("a", "b")]
    if name not in registry.COMPOSITIONS:
        raise ValueError(f"no composition {name}")
    if name not in ("ImageCompIdentityLeft", "ImageCompIdentityRight", *columns._DARK):
        made = registry.COMPOSITIONS[name][1]
        return map_stacks(both, lambda a, b: {"pixels": flat(made(a, b))}, ["a", "b"], "pixels array<int>", keep)
    return both.select(*keep, columns.composed(F.col("a"), F.col("b"), name).alias("pixels"))


def chain(images: DataFrame, transforms: list[str | registry.Transform]) -> DataFrame:
    """Transforms, by registered name or as they are, left to right."""
    steps = [t.apply for t in registry.resolve(transforms)]

    def f(x):
        for apply in steps:
            x = apply(x)
        return {"pixels": flat(x), "h": [x.shape[1]] * len(x), "w": [x.shape[2]] * len(x)}

    return map_stacks(images, f, ["pixels"], "pixels array<int>, h int, w int", ["img_id"]).select("img_id", "h", "w", "pixels")


def chosen_transforms(angle: int = 0, hf: int = 0, vf: int = 0, ryx: int = 0, rynx: int = 0, fill: int = 0) -> list[str]:
    """Names for rotation, flips, reflections and fill (1 unfills, 2 fills), in this order; ValueError for other values."""
    def pick(value, options, what):
        if value not in options:
            raise ValueError(f"{what} must be one of {sorted(options)}")
        return options[value]

    return [
        pick(angle, {0: "Identity", 90: "Rotate90", 180: "Rotate180", 270: "Rotate270"}, "angle"),
        pick(hf, {0: "Identity", 1: "HorizontalFlip"}, "hf"),
        pick(vf, {0: "Identity", 1: "VerticalFlip"}, "vf"),
        pick(ryx, {0: "Identity", 1: "ReflectYX"}, "ryx"),
        pick(rynx, {0: "Identity", 1: "ReflectYnX"}, "rynx"),
        pick(fill, {0: "Identity", 1: "ShapeUnfiller", 2: "ShapeFiller"}, "fill"),
    ]


def transforms_table(spark: SparkSession) -> DataFrame:
    """The ten transforms: ti, name, complexity and the ten decoded fields (angle for rotations, else 0 or 1)."""
    # Names of the decoded fields, in the order of the transforms.
    fields = ["id", "r90", "r180", "r270", "hf", "vf", "f_rynx", "f_ryx", "fill", "unfill"]
    rows = []
    for ti, name in enumerate(blocks.TRANSFORM_NAMES):
        values = [0] * 10
        values[ti] = 90 * ti if ti in (1, 2, 3) else 1
        rows.append((ti, name, blocks.COMPLEXITIES[ti], *values))
    return spark.createDataFrame(rows, "ti int, name string, complexity int, " + ", ".join(f"{f} int" for f in fields))


def compositions_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(blocks.COMPOSITIONS.items()), "x int, name string")


def candidate_transforms(spark: SparkSession, max_n: int = 3, max_complexity: int = 10) -> DataFrame:
    """Sets of up to max_n transforms whose complexities sum to less than max_complexity: n, names, complexity, text."""
    rows = [
        (len(c), names := [blocks.TRANSFORM_NAMES[i] for i in c], total, registry.text(names))
        for n in range(1, max_n + 1)
        for c in combinations(range(10), n)
        if (total := sum(blocks.COMPLEXITIES[i] for i in c)) < max_complexity
    ]
    return spark.createDataFrame(rows, "n int, names array<string>, complexity int, text string")


def candidate_translations(spark: SparkSession, tx: list[int], ty: list[int]) -> DataFrame:
    """Chains of one translation for each tx and ty: tx, ty, complexity, text."""
    rows = [(x, y, registry.complexity([t]), registry.text([t])) for x in tx for y in ty for t in [registry.translation(x, y)]]
    return spark.createDataFrame(rows, "tx int, ty int, complexity int, text string")


def repeated(cells: DataFrame, passes: int) -> DataFrame:
    """Every row ``passes`` times, numbered from 0 in ``pass``: the cells of a grid gone over again and again."""
    return cells.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)) if passes > 0 else F.array().cast("array<int>")))


def same_chain(a: Column, b: Column) -> Column:
    """Whether two arrays of transform names are equal once identities are left out."""
    clean = lambda c: F.filter(c, lambda t: t != "Identity")
    return clean(a) == clean(b)
