"""Similarity of image pairs (columns a and b of one shape), row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, columns
from .stacks import flat, map_stacks


def cw_ssim(both: DataFrame, widths: int = 30) -> DataFrame:
    """``score``; equal pairs of contents should be made distinct before this, see :func:`distinct_scores`."""
    keep = [c for c in both.columns if c not in ("a", "b")]
    return map_stacks(both, lambda a, b: {"score": blocks.cw_ssim(a, b, widths)}, ["a", "b"], "score double", keep)


def distinct_scores(both: DataFrame, widths: int = 30) -> DataFrame:
    """CW-SSIM computed once for each distinct pair of contents."""
    once = both.select("h", "w", "a", "b").distinct()
    scored = map_stacks(once, lambda a, b: {"score": blocks.cw_ssim(a, b, widths)}, ["a", "b"], "score double", ["h", "w", "a", "b"])
    return both.join(scored, ["h", "w", "a", "b"]).drop("a", "b")


def wavelets(images: DataFrame, widths: int) -> DataFrame:
    """img_id, width, p, value: causal Ricker wavelet transform of the pixels in row-major order."""

    def f(x):
        flat_x = x.reshape(len(x), -1).astype(float)
        m = blocks.wavelet_matrices(flat_x.shape[1], widths)
        return {"levels": [list(v) for v in (flat_x @ m.transpose(0, 2, 1)).transpose(1, 0, 2)]}

    out = map_stacks(images, f, ["pixels"], "levels array<array<double>>", ["img_id"])
    per = out.select("img_id", F.posexplode("levels").alias("width", "v"))
    return per.select("img_id", (F.col("width") + 1).alias("width"), F.posexplode("v").alias("p", "value"))


def ssim_map(both: DataFrame) -> DataFrame:
    """Structural similarity at every pixel, in row-major order, as ``similarity``."""
    keep = [c for c in both.columns if c not in ("a", "b")]
    return map_stacks(both, lambda a, b: {"similarity": flat(blocks.ssim_map(a, b))}, ["a", "b"], "similarity array<double>", keep)


def cw_ssim_map(both: DataFrame, widths: int = 30) -> DataFrame:
    """Complex-wavelet similarity at every pixel, in row-major order, as ``similarity``."""
    keep = [c for c in both.columns if c not in ("a", "b")]
    return map_stacks(both, lambda a, b: {"similarity": list(blocks.cw_ssim_map(a, b, widths))}, ["a", "b"], "similarity array<double>", keep)


def ssim(both: DataFrame, window: int = 11) -> DataFrame:
    keep = [c for c in both.columns if c not in ("a", "b")]
    return map_stacks(both, lambda a, b: {"score": blocks.ssim(a, b, window)}, ["a", "b"], "score double", keep)


def _counts(a: Column, b: Column) -> tuple[Column, Column]:
    outside = lambda name: columns.total(F.transform(columns.composed(a, b, name), lambda v: (v > 0).cast("int")))
    return outside("ImageIntersection"), outside("ImageUnion")


def image_jaccard(a: Column, b: Column) -> Column:
    """White of the intersection over white of the union, at least 1; null where the union is all black."""
    i, u = _counts(a, b)
    return F.when(u > 0, i / F.when(u > 0, u))


def image_tversky(a: Column, b: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """As :func:`image_jaccard` with 1e-6 added below; the weights have no effect, and larger means less alike."""
    i, u = _counts(a, b)
    return i / (u + F.lit(1e-6))


def frobenius(a: Column, b: Column, wrap: bool = True) -> Column:
    return F.sqrt(columns.square_error(a, b, wrap))


def best_composition(triples: DataFrame, metric: str = "cw_ssim", widths: int = 5) -> DataFrame:
    """Columns a, b and target c: the composition of a and b most like c (number, name, score, pixels)."""
    keep = [c for c in triples.columns if c not in ("a", "b", "c")]

    def f(a, b, c):
        x, score, made = blocks.best_composition(a, b, c, widths, metric)
        return {"x": x, "comp_name": [blocks.COMPOSITIONS[int(i)] for i in x], "score": score, "pixels": flat(made)}

    return map_stacks(triples, f, ["a", "b", "c"], "x int, comp_name string, score double, pixels array<int>", keep)
