"""Named queries over the driver tables; the SQL that checks them is in :mod:`oracle`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, columns, registry
from ..operators import analogy, components, encode, features, images, metrics
from ..sources import images as src
from ..sources import problems as prob
from .oracle import ORACLE  # noqa: F401
from .session import ship

QUERIES: dict = {}
GRID = 4
KERNEL = [[1, 2, 1], [0, 4, 0], [-1, 0, 3]]
ANSWERS = [f"A:B::C:{i}" for i in range(1, 7)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def pictures(spark: SparkSession, sf_dir: str, variant: str = "grey") -> DataFrame:
    ship(spark)
    return src.from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), variant)


def _sum(df: DataFrame, *keep: str) -> DataFrame:
    """A row per image: position-weighted checksum and plain sum."""
    return df.select(*keep, columns.checksum(F.col("pixels")).alias("checksum"), columns.total(F.col("pixels")).alias("total"))


def _pairs(spark, sf_dir, variant="grey", every=2) -> DataFrame:
    return images.pairs(pictures(spark, sf_dir, variant), every)


def _encodings(pics: DataFrame, grid: int = GRID, sources: int = 1) -> DataFrame:
    """Image 2k (and 2k + 1) as domain, the next one as range."""
    n = sources + 1
    ids = pics.groupBy(F.floor(F.col("img_id") / n).alias("encoding_id")).agg(F.count("*").alias("c")).where(F.col("c") == n)
    e = F.col("encoding_id")
    second = (e * n + 1) if sources == 2 else F.lit(None).cast("long")
    return ids.select("encoding_id", (e * n).alias("domain1"), second.alias("domain2"), (e * n + n - 1).alias("range_img"), F.lit(grid).alias("grid"))


@query
def px_build(spark, sf_dir):
    px = src.explode_pixels(pictures(spark, sf_dir))
    return px.groupBy("img_id").agg(F.sum("v").alias("total"), F.sum(F.col("v").cast("long") * (F.col("y") * 8 + F.col("x") + 1)).alias("checksum"))


@query
def whitespace_ratio(spark, sf_dir):
    p = F.col("pixels")
    return pictures(spark, sf_dir).select("img_id", columns.whitespace_area(p).alias("area"), columns.whitespace_ratio(p).alias("ratio"))


@query
def tile_filter(spark, sf_dir):
    t = images.tiles(pictures(spark, sf_dir, "sparse"), GRID)
    return t.select("img_id", "dx", "dy", columns.not_white(F.col("d")).alias("kept"), columns.checksum(F.col("d")).alias("checksum"))


@query
def block_mean_reduce(spark, sf_dir):
    r = images.reduce(pictures(spark, sf_dir), 3)
    return r.select("img_id", F.posexplode("pixels").alias("p", "mean")).select("img_id", "p", F.round("mean", 9).alias("mean"))


@query
def crop_center(spark, sf_dir):
    return _sum(images.crop(pictures(spark, sf_dir), 5, 5), "img_id", "h", "w")


@query
def pad_white(spark, sf_dir):
    return _sum(images.pad(pictures(spark, sf_dir), 11, 9), "img_id", "h", "w")


@query
def transform_d4(spark, sf_dir):
    t = images.transformed(images.tiles(pictures(spark, sf_dir), 8), 8)
    return t.select("img_id", F.col("ti").cast("int").alias("ti"), columns.checksum(F.col("d")).alias("checksum"))


@query
def translate_xy(spark, sf_dir):
    return _sum(images.translate(pictures(spark, sf_dir), 2, -3), "img_id")


@query
def translations_grid(spark, sf_dir):
    ship(spark)
    return images.candidate_translations(spark, [-1, 0, 2], [0, 3]).select("tx", "ty")


@query
def translate_chain(spark, sf_dir):
    return _sum(images.chain(pictures(spark, sf_dir), ["Rotate90", registry.translation(2, -3)]), "img_id")


@query
def compose_text(spark, sf_dir):
    ship(spark)
    both = images.candidate_transforms(spark), images.candidate_translations(spark, [-1, 0, 2], [0, 3])
    return both[0].select("text", "complexity").union(both[1].select("text", "complexity"))


@query
def compose_transform_args(spark, sf_dir):
    names = images.chosen_transforms(angle=90, hf=1, rynx=1)
    return _sum(images.chain(pictures(spark, sf_dir), names), "img_id")


@query
def compose_transform_fill(spark, sf_dir):
    names = images.chosen_transforms(angle=180, vf=1, ryx=1, fill=2)
    return _sum(images.chain(pictures(spark, sf_dir, "sparse"), names), "img_id")


@query
def compose_transform_unfill(spark, sf_dir):
    names = images.chosen_transforms(angle=270, hf=1, fill=1)
    return _sum(images.chain(pictures(spark, sf_dir), names), "img_id")


@query
def grey_of_colours(spark, sf_dir):
    """Luma of neighbouring images as red, green and blue, after the channel count is checked."""
    t = _pairs(spark, sf_dir, "grey", 3).withColumn("n", src.channels(F.lit(3)))
    grey = F.transform(F.arrays_zip("a", "b", "c"), lambda p: src.luma(p["a"], p["b"], p["c"]))
    return _sum(t.withColumn("pixels", grey), "pair_id", "n")


@query
def transforms_dimension(spark, sf_dir):
    ship(spark)
    return images.transforms_table(spark)


@query
def compositions_dimension(spark, sf_dir):
    ship(spark)
    return images.compositions_table(spark)


@query
def candidate_transforms_n3(spark, sf_dir):
    ship(spark)
    c = images.candidate_transforms(spark)
    return c.select("n", F.array_join("names", "+").alias("names"), "complexity")


@query
def chain_equality(spark, sf_dir):
    ship(spark)
    c = images.candidate_transforms(spark, 2).select(F.array_join("names", "+").alias("names"), images.same_chain(F.col("names"), F.array(F.lit("Rotate90"))).alias("same"))
    return c.where("same").select("names")


@query
def fill_shape(spark, sf_dir):
    px = images.fill(src.explode_pixels(pictures(spark, sf_dir, "sparse")))
    return px.groupBy("img_id").agg(F.sum(F.when(F.col("v") == 0, F.col("y") * 8 + F.col("x") + 1).otherwise(0)).cast("long").alias("dark"))


@query
def fill_stacked(spark, sf_dir):
    f = images.filtered(pictures(spark, sf_dir, "sparse"), "fill")
    return f.select("img_id", columns.total(F.transform("pixels", lambda v, i: F.when(v == 0, i + 1).otherwise(0))).alias("dark"))


@query
def unfill_shape(spark, sf_dir):
    return _sum(images.filtered(pictures(spark, sf_dir), "unfill"), "img_id")


@query
def sobel_edges(spark, sf_dir):
    e = images.filtered(pictures(spark, sf_dir), "edges")
    return e.select("img_id", F.posexplode("pixels").alias("p", "e")).select("img_id", "p", F.round("e", 6).alias("edge"))


@query
def blur_gauss(spark, sf_dir):
    b = images.convolve(pictures(spark, sf_dir), blocks.gaussian(3, 1.0).tolist())
    return b.select("img_id", F.posexplode("pixels").alias("p", "v")).select("img_id", "p", F.round("v", 6).alias("value"))


@query
def convolve_kernel(spark, sf_dir):
    return images.convolve(pictures(spark, sf_dir), KERNEL).select("img_id", columns.checksum(F.transform("pixels", lambda v: v.cast("long"))).alias("checksum"))


def _composition(name: str, key: str):
    def run(spark, sf_dir):
        return _sum(images.compose(_pairs(spark, sf_dir), name), "pair_id")

    QUERIES[key] = run


for _key, _name in (("compose_left", "ImageCompIdentityLeft"), ("compose_right", "ImageCompIdentityRight"), ("compose_union", "ImageUnion"), ("compose_intersection", "ImageIntersection"), ("compose_subtract", "ImageSubtract"), ("compose_backsubtract", "ImageBacksubtract")):
    _composition(_name, _key)


@query
def compose_xor(spark, sf_dir):
    b = _pairs(spark, sf_dir)
    half = F.transform("a", lambda v: F.when(v < 128, 0).otherwise(v))
    other = F.transform("b", lambda v: F.when(v < 128, 0).otherwise(v))
    return _sum(images.compose(b.withColumns({"a": half, "b": other}), "ImageXOR"), "pair_id")


@query
def compose_registered(spark, sf_dir):
    """A composition that is none of the six: the lighter pixel."""
    if "ImageLighter" not in registry.COMPOSITIONS:
        registry.register_composition("ImageLighter", lambda a, b: np.maximum(a, b))
    return _sum(images.compose(_pairs(spark, sf_dir), "ImageLighter"), "pair_id")


@query
def frobenius_wrap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.frobenius(F.col("a"), F.col("b")).alias("error"))


@query
def frobenius_exact(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.frobenius(F.col("a"), F.col("b"), False).alias("error"))


@query
def correspondence_weights(spark, sf_dir):
    p = pictures(spark, sf_dir, "sparse")
    return encode.weights(_encodings(p), p, GRID)


@query
def color_contraction(spark, sf_dir):
    b = _pairs(spark, sf_dir)
    return b.select("pair_id", F.lit(0.75).cast("double").alias("contrast"), columns.brightness(columns.total(F.col("b")), columns.total(F.col("a")), 64).alias("brightness"))


@query
def match_2x1_argmin(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    codes = encode.encode(_encodings(p), p, n_transforms=8, composition=False, details=True)
    return codes.select("encoding_id", "dx", "dy", "sx", "sy", "ti", "brightness", "err")


@query
def match_2x1_relational(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    return encode.encode_relational(_encodings(p), p, GRID)


@query
def match_blank_default(spark, sf_dir):
    p = pictures(spark, sf_dir, "sparse")
    codes = encode.encode(_encodings(p), p, n_transforms=8, composition=False)
    blank = p.where(~columns.not_white(F.col("pixels"))).select(F.col("img_id").alias("domain1"))
    return codes.join(_encodings(p).join(blank, "domain1").select("encoding_id"), "encoding_id").select("encoding_id", "dx", "dy", "sx", "sy", "ti", "contrast", "brightness", "comp", "grid")


@query
def match_3x1_argmin(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    codes = encode.encode(_encodings(p, sources=2), p, n_transforms=8, composition=False, details=True)
    return codes.select("encoding_id", "dx", "dy", "src", "sx", "sy", "ti", "brightness")


@query
def cw_ssim_pair(spark, sf_dir):
    return metrics.cw_ssim(_pairs(spark, sf_dir), 5).select("pair_id", F.round("score", 6).alias("score"))


@query
def wavelet_transform(spark, sf_dir):
    w = metrics.wavelets(pictures(spark, sf_dir), 3)
    return w.select("img_id", "width", "p", F.round("value", 6).alias("value"))


@query
def cw_ssim_distinct(spark, sf_dir):
    return metrics.distinct_scores(_pairs(spark, sf_dir), 2).select("pair_id", F.round("score", 6).alias("score"))


@query
def ssim_pair(spark, sf_dir):
    return metrics.ssim(_pairs(spark, sf_dir)).select("pair_id", F.round("score", 6).alias("score"))


@query
def ssim_map(spark, sf_dir):
    m = metrics.ssim_map(_pairs(spark, sf_dir))
    return m.select("pair_id", F.posexplode("similarity").alias("p", "value")).select("pair_id", "p", F.round("value", 6).alias("value"))


@query
def cw_ssim_map(spark, sf_dir):
    m = metrics.cw_ssim_map(_pairs(spark, sf_dir), 3)
    return m.select("pair_id", F.posexplode("similarity").alias("p", "value")).select("pair_id", "p", F.round("value", 6).alias("value"))


@query
def image_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.image_jaccard(F.col("a"), F.col("b")).alias("score"))


@query
def image_tversky(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair_id", metrics.image_tversky(F.col("a"), F.col("b")).alias("score"))


@query
def best_composition(spark, sf_dir):
    t = _pairs(spark, sf_dir, "binary", 3)
    return metrics.best_composition(t).select("pair_id", "x", "comp_name", F.round("score", 6).alias("score"))


def _by_metric(metric: str):
    def run(spark, sf_dir):
        t = _pairs(spark, sf_dir, "binary", 3)
        return metrics.best_composition(t, metric).select("pair_id", "x", F.round("score", 6).alias("score"))

    QUERIES[f"best_composition_{metric}"] = run


for _metric in ("rmse", "ssim", "tversky"):
    _by_metric(_metric)


@query
def encode_2x1(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    return encode.encode(_encodings(p), p)


@query
def encode_3x1(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    return encode.encode(_encodings(p, sources=2), p)


def _codes(spark, sf_dir) -> DataFrame:
    p = pictures(spark, sf_dir, "binary")
    return encode.encode(_encodings(p), p)


@query
def feature_strings(spark, sf_dir):
    return features.features(_codes(spark, sf_dir))


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Features of even and of odd encodings, under one key."""
    f = features.features(_codes(spark, sf_dir)).select(F.floor(F.col("encoding_id") / 2).alias("k"), (F.col("encoding_id") % 2).alias("odd"), "feature").distinct()
    return f.where("odd = 0").select("k", "feature"), f.where("odd = 1").select("k", "feature")


@query
def feature_union(spark, sf_dir):
    return features.union(*_halves(spark, sf_dir))


@query
def feature_intersection(spark, sf_dir):
    return features.intersection(*_halves(spark, sf_dir))


@query
def feature_difference(spark, sf_dir):
    return features.difference(*_halves(spark, sf_dir))


@query
def feature_jaccard(spark, sf_dir):
    return features.similarity(*_halves(spark, sf_dir), "k").select("k", F.round("score", 9).alias("score"))


@query
def brightness_bins(spark, sf_dir):
    ship(spark)
    return spark.range(-255, 256).select(F.col("id").cast("int").alias("b")).select("b", columns.brightness_bin(F.col("b")).alias("bin"))


def _problems(spark, sf_dir):
    p = pictures(spark, sf_dir, "binary")
    problems, figures = prob.from_images(p)
    return p, prob.analogies(problems, ANSWERS), figures, problems


@query
def problem_records(spark, sf_dir):
    _, _, figures, problems = _problems(spark, sf_dir)
    return figures.join(problems, "problem_id").select("problem_id", "name", "ptype", "figure", "img_id")


@query
def mutual_features(spark, sf_dir):
    p, a, figures, _ = _problems(spark, sf_dir)
    return analogy.mutual_features(a, figures, p, [GRID]).select("problem_id", "analogy", "side", "feature")


@query
def analogy_score(spark, sf_dir):
    p, a, figures, _ = _problems(spark, sf_dir)
    s = analogy.scores(a, figures, p, GRID)
    return s.select("problem_id", "analogy", F.round("score", 9).alias("score"))


@query
def analogy_triplets(spark, sf_dir):
    p, _, figures, problems = _problems(spark, sf_dir)
    s = analogy.scores(prob.analogies(problems, ["A:B:C::4:5:6"]), figures, p, GRID)
    return s.select("problem_id", "analogy", F.round("score", 9).alias("score"))


@query
def analogy_multiscale(spark, sf_dir):
    p, a, figures, _ = _problems(spark, sf_dir)
    s = analogy.multiscale_scores(a, figures, p, [4, 8])
    return s.select("problem_id", "analogy", F.round("score", 9).alias("score"))


@query
def best_answers(spark, sf_dir):
    p, a, figures, _ = _problems(spark, sf_dir)
    s = analogy.scores(a, figures, p, GRID)
    return analogy.best_answers(s.withColumn("score", F.round("score", 9)))


def _decoded(spark, sf_dir, n: int, sources: int = 1) -> tuple[DataFrame, DataFrame]:
    p = pictures(spark, sf_dir, "binary")
    e = _encodings(p, sources=sources)
    codes = encode.encode(e, p)
    img = F.struct("h", "w", "pixels")
    s = e.join(p.select(F.col("img_id").alias("domain1"), "h", "w", img.alias("source1")), "domain1")
    s = s.join(p.select(F.col("img_id").alias("domain2"), img.alias("source2")), "domain2", "left").select("encoding_id", "h", "w", "source1", "source2")
    targets = e.join(p.select(F.col("img_id").alias("range_img"), "pixels"), "range_img").select("encoding_id", "pixels")
    return encode.decode(codes, s, n), targets


@query
def decode_n(spark, sf_dir):
    return _steps(_decoded(spark, sf_dir, 8)[0])


@query
def decode_two_sources(spark, sf_dir):
    return _steps(_decoded(spark, sf_dir, 8, 2)[0])


def _steps(decoded: DataFrame) -> DataFrame:
    return decoded.select("encoding_id", "step", F.posexplode("pixels").alias("p", "value")).select("encoding_id", "step", "p", F.round("value", 6).alias("value"))


@query
def decode_quality(spark, sf_dir):
    q = encode.decode_quality(*_decoded(spark, sf_dir, 4), 5)
    return q.select("encoding_id", "step", F.round("score", 6).alias("score"))


@query
def label_components(spark, sf_dir):
    m = src.mosaics(pictures(spark, sf_dir, "sparse"))
    inverted = m.withColumn("pixels", F.transform("pixels", lambda v: 255 - v))
    return components.component_sets(components.label_components(inverted)).select("img_id", "label", "n_pixels", F.col("positions")[0].alias("first"))


@query
def neighbour_labels(spark, sf_dir):
    inverted = pictures(spark, sf_dir, "sparse").withColumn("pixels", F.transform("pixels", lambda v: 255 - v))
    n = components.neighbour_labels(components.label_components(inverted))
    return n.groupBy("img_id").agg(F.sum(F.size("neighbours")).alias("n_neighbours"))


@query
def mosaic_build(spark, sf_dir):
    return _sum(src.mosaics(pictures(spark, sf_dir)), "img_id", "h", "w")


@query
def blur_planes(spark, sf_dir):
    """Colour images as planes: three neighbouring images are the channels of one."""
    soft = images.blur(pictures(spark, sf_dir), 3, 1.0)
    planes = soft.select(F.floor(F.col("img_id") / 3).alias("img_id"), (F.col("img_id") % 3).cast("int").alias("c"), "h", "w", "pixels")
    whole = src.merge_planes(src.rgb_planes(planes)).where(F.size("planes") == 3)
    return whole.select("img_id", *[columns.checksum(F.col("planes")[i]).alias(n) for i, n in enumerate("rgb")])


@query
def resize_bicubic(spark, sf_dir):
    return _sum(images.resize(pictures(spark, sf_dir), 12, 5), "img_id", "h", "w")


@query
def chunks_of_n(spark, sf_dir):
    c = encode.chunks(pictures(spark, sf_dir).select("img_id"), "img_id", 7)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("img_id").alias("first"), F.max("img_id").alias("last"))


@query
def repeated_cells(spark, sf_dir):
    t = images.tiles(pictures(spark, sf_dir), GRID).select("img_id", "dx", "dy")
    return images.repeated(t, 2).groupBy("img_id").agg(F.count("*").alias("n_cells"))
