"""Fractal encoding of many image pairs at once, and decoding.

An encoding says how the tiles of a range image are best made of transformed
tiles of one or two domain images.  The search is local to an encoding and
a run of its range tiles: such work units carry the domain images and their own
rows of the range image, and are dealt out over the cluster one by one, so that
a single pair of large images uses all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, columns
from . import images as ops

CODE = "encoding_id long, dx int, dy int, sx int, sy int, ti int, contrast double, brightness int, comp int, grid int"
CONTRAST, BLANK_BRIGHTNESS, EPS = 0.75, 255, 10
#: Candidates (range tiles x domain tiles x transforms) that one work unit compares at most.
UNIT_CANDIDATES = 4_000_000
#: Pixel differences that are held at once.
CELLS = 8_000_000


def _sizes(r: np.ndarray, forms: np.ndarray, wraps: np.ndarray) -> np.ndarray:
    """Sums of squared differences (e, m, k, t) of range tiles (e, m, p) and forms (e, k, t, p), modulo 256 pixel by pixel where ``wraps``."""
    diff = forms[:, None] - r[:, :, None, None]
    diff *= diff
    return np.where(wraps, (diff & 255).sum(-1), diff.sum(-1)) if wraps.any() else diff.sum(-1)


def search(r: np.ndarray, sources: list[np.ndarray], dark: np.ndarray, at: np.ndarray, every: int, per_row: int, per_row_d: int, n_ti: int, wrap: bool, composition: bool) -> dict[str, np.ndarray]:
    """Codes of range tiles (e, m, g, g) of e encodings against their domain tiles, each source (e, k, g, g).

    ``dark`` (e, k): which domain tiles take part, at least one for each
    encoding; ``at`` (e, m): numbers of the range tiles, of which an encoding
    has ``every`` in rows of ``per_row``.  Order of candidates: error, then
    source, row, column, transform.  Arrays of shape (e, m) by column.
    """
    e, m, g = r.shape[:3]
    k = sources[0].shape[1]
    dx, dy = at // per_row * g, at % per_row * g
    corner = np.stack([np.arange(k) // per_row_d * g, np.arange(k) % per_row_d * g])
    first = np.where(dark[:, None], corner, np.iinfo(np.int64).max).min(2)
    far = np.sqrt(((every // per_row - 1) * g - first[:, 0]).astype(float) ** 2 + ((per_row - 1) * g - first[:, 1]).astype(float) ** 2)
    w2 = 1.0 / (far + EPS)
    small = max(int(x.max(initial=0)) for x in (r, *sources)) <= 255 and min(int(x.min(initial=0)) for x in (r, *sources)) >= 0 and g <= 180
    flat = lambda x: x.reshape(*x.shape[:2], -1).astype(np.int32 if small else np.int64)
    own = flat(r)
    forms = [np.stack([blocks.transform(d.reshape(e * k, g, g), ti).reshape(e, k, -1) for ti in range(n_ti)], axis=2).astype(own.dtype) for d in sources]
    dist = np.sqrt((dx[:, :, None] - corner[0]).astype(float) ** 2 + (dy[:, :, None] - corner[1]).astype(float) ** 2)
    wraps = np.array([wrap and ti != blocks.UNFILL for ti in range(n_ti)])
    choice, least = np.zeros((len(sources), e, m), np.int64), np.full((len(sources), e, m), np.inf)
    cells = k * n_ti * g * g
    some_e = max(1, CELLS // (cells * m))
    some_m = m if some_e > 1 else max(1, CELLS // cells)
    for s, f in enumerate(forms):
        for i in range(0, e, some_e):
            for j in range(0, m, some_m):
                part = (slice(i, i + some_e), slice(j, j + some_m))
                err = 1 * np.sqrt(_sizes(own[part], f[part[0]], wraps).astype(float)) + w2[part[0], None, None, None] * dist[part][..., None]
                err[~np.broadcast_to(dark[part[0], None, :, None], err.shape)] = np.inf
                err = err.reshape(*err.shape[:2], -1)
                choice[s][part] = err.argmin(2)
                least[s][part] = err.min(2)
    win = least.argmin(0)
    best = np.take_along_axis(choice, win[None], 0)[0]
    tile, ti = best // n_ti, best % n_ti
    row = np.arange(e)[:, None]
    made = [f[row, tile, ti].reshape(e * m, g, g).astype(np.int64) for f in forms]
    target = r.reshape(e * m, g, g)
    x = np.zeros(e * m, np.int64)
    if len(sources) == 1:
        image = made[0]
        if composition:
            x = blocks.best_composition(image, target, target, 5, wrap=wrap)[0]
    elif composition:
        x, _, image = blocks.best_composition(*made, target, 2, wrap=wrap)
    else:
        image = np.where((win.ravel() == 0)[:, None, None], *made)
    total = lambda z: z.reshape(e * m, -1).astype(np.int64).sum(1)
    light = blocks.brightness(total(target), total(image), g * g).reshape(e, m)
    return {"dx": dx, "dy": dy, "sx": corner[0][tile], "sy": corner[1][tile], "ti": ti, "brightness": light, "comp": x.reshape(e, m), "err": least.min(0), "src": win + 1}


def encode(encodings: DataFrame, images: DataFrame, n_transforms: int = 10, error_mode: str = "wrap256", composition: bool = True, details: bool = False, carry: bool = False) -> DataFrame:
    """Codebooks, one row per code.

    ``encodings``: encoding_id, domain1, domain2 (null for one source),
    range_img, grid; ``images``: img_id, h, w, pixels.  Equal encodings under
    several ids are searched once.  A domain without a black pixel gives the
    default code for each range tile; a grid larger than the range image gives
    none; an unknown image gives none.  Two sources must have one shape.
    ``composition=False`` leaves comp 0 (two sources: the better one).
    ``carry``: encodings are all different and have a column ``carry``, which
    stands with every code; nothing is joined back.
    """
    if error_mode not in ("wrap256", "exact"):
        raise ValueError("error_mode is wrap256 or exact")
    what = ["domain1", "domain2", "range_img", "grid"]
    more = ["carry"] if carry else []
    once = encodings if carry else encodings.groupBy(*what).agg(F.min("encoding_id").alias("encoding_id"))
    take = lambda n: images.select(F.col("img_id").alias(n), F.struct("h", "w", "pixels").alias(f"_{n}"))
    full = once.join(take("range_img"), "range_img").join(take("domain1"), "domain1").join(take("domain2"), "domain2", "left")
    full = full.where("domain2 is null or _domain2 is not null").select("encoding_id", "grid", *more, *[F.col(f"_{n}").alias(n) for n in ("domain1", "domain2", "range_img")])
    count = lambda n: F.floor(F.col(f"{n}.h") / F.col("grid")) * F.floor(F.col(f"{n}.w") / F.col("grid"))
    per = F.greatest(F.lit(1), F.floor(F.lit(UNIT_CANDIDATES) / F.greatest(F.lit(1), count("domain1") * n_transforms)))
    units = full.where(count("range_img") > 0).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), count("range_img") - 1, per))).withColumn("per", per)
    # a unit's own rows of the range image; rows are counted in pixels
    wide = F.col("range_img.w")
    across = F.floor(wide / F.col("grid"))
    top = F.floor(F.col("lo") / across) * F.col("grid")
    below = F.least((F.floor((F.col("lo") + F.col("per") - 1) / across) + 1) * F.col("grid"), F.floor(F.col("range_img.h") / F.col("grid")) * F.col("grid"))
    own = F.slice("range_img.pixels", (top * wide + 1).cast("int"), ((below - top) * wide).cast("int"))
    units = units.select("encoding_id", "grid", *more, "domain1", "domain2", F.struct((below - top).cast("int").alias("h"), wide.alias("w"), own.alias("pixels")).alias("range_img"), "lo", "per", count("range_img").alias("every"))
    units = units.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "encoding_id", "lo")  # a number, or Spark would join small ones again
    wrap = error_mode == "wrap256"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # units of one shape are searched together
            alike: dict[tuple, list[int]] = {}
            for i, (g, s1, s2, sr, n, lo, every) in enumerate(zip(*(b[c] for c in ("grid", "domain1", "domain2", "range_img", "per", "lo", "every")), strict=True)):
                two = s2 is not None and s2["pixels"] is not None
                shape = (int(s1["h"]), int(s1["w"]))  # sizes are float where a batch has nulls
                if two and (int(s2["h"]), int(s2["w"])) != shape:
                    raise ValueError("two domain images must have one shape")
                alike.setdefault((int(g), shape, two, int(sr["h"]), int(sr["w"]), int(every), int(min(n, every - lo))), []).append(i)
            for (g, (h, w), two, rh, rw, every, m), rows in alike.items():
                step = max(1, min(2_000, CELLS // (4 * (2 * h * w + rh * rw) + 1)))
                for k in range(0, len(rows), step):
                    some = rows[k : k + step]
                    part = b.iloc[some]
                    stack = lambda c, hh, ww: np.stack([np.asarray(s["pixels"], np.int64) for s in part[c]]).reshape(-1, hh, ww)  # noqa: B023, E731
                    sources = [blocks.stack_tiles(stack(c, h, w), g) for c in (("domain1", "domain2") if two else ("domain1",))]
                    lo, cols = part["lo"].to_numpy(np.int64), rw // g
                    tiles = blocks.stack_tiles(stack("range_img", rh, rw), g)
                    own = tiles[np.arange(len(some))[:, None], lo[:, None] % cols + np.arange(m)]
                    at = lo[:, None] + np.arange(m)
                    dark = np.any([(d <= 128).any(axis=(2, 3)) for d in sources], axis=0)
                    found = dark.any(1)
                    none = np.zeros((len(some), m), np.int64)
                    codes = {"dx": at // cols * g, "dy": at % cols * g, "sx": none, "sy": none, "ti": none, "brightness": none + BLANK_BRIGHTNESS, "comp": none, "err": none + np.nan, "src": none}
                    if found.any():
                        got = search(own[found], [d[found] for d in sources], dark[found], at[found], every, cols, w // g, n_transforms, wrap, composition)
                        codes = {c: np.array(v) for c, v in codes.items()}
                        for c, v in got.items():
                            codes[c][found] = v
                    out = pd.DataFrame({c: v.ravel() for c, v in codes.items()}).assign(contrast=CONTRAST, grid=g, encoding_id=np.repeat(part["encoding_id"].to_numpy(), m))
                    if carry:
                        held = part["carry"].tolist()
                        out["carry"] = [v for v in held for _ in range(m)]
                    yield out[[*names, *more]]

    kind = CODE + ", err double, src int"
    names = [x.split()[0] for x in kind.split(", ")]
    codes = units.mapInPandas(run, kind + "".join(f", {c} {encodings.schema[c].dataType.simpleString()}" for c in more))
    if carry:
        return codes.select(*[n for n in names if details or n not in ("err", "src")], "carry")
    ids = once.select(F.col("encoding_id").alias("_one"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_k{i}") for i, c in enumerate(what)])
    own = encodings.select(F.col("encoding_id").alias("_own"), *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(f"_k{i}") for i, c in enumerate(what)])
    same = own.join(ids, [f"_k{i}" for i in range(len(what))]).select("_own", "_one")
    out = same.join(codes.withColumnRenamed("encoding_id", "_one"), "_one").withColumnRenamed("_own", "encoding_id")
    return out.select(*[n for n in names if details or n not in ("err", "src")])


def encode_relational(encodings: DataFrame, images: DataFrame, g: int, last: int = 7) -> DataFrame:
    """The one-source search of transforms 0..last as joins, without compositions: for small images and as a check.

    Candidates of one encoding only meet each other; the minimum is taken per
    task before its shuffle.
    """
    e = encodings.select("encoding_id", "domain1", "range_img")
    rng = e.join(ops.tiles(images, g).withColumnRenamed("img_id", "range_img"), "range_img").select("encoding_id", "dx", "dy", F.col("d").alias("r"))
    kept = ops.tiles(images, g).where(columns.not_white(F.col("d"))).withColumnRenamed("img_id", "domain1")
    dom = ops.transformed(e.join(kept, "domain1").select("encoding_id", F.col("dx").alias("sx"), F.col("dy").alias("sy"), "d"), g, last)
    far = rng.groupBy("encoding_id").agg(F.max("dx").alias("mx"), F.max("dy").alias("my")).join(dom.groupBy("encoding_id").agg(F.min("sx").alias("nx"), F.min("sy").alias("ny")), "encoding_id")
    w = far.select("encoding_id", (1.0 / (_distance("mx", "my", "nx", "ny") + EPS)).alias("w2"))
    both = rng.join(dom, "encoding_id").join(w, "encoding_id")
    err = F.sqrt(columns.square_error(F.col("d"), F.col("r"))) + F.col("w2") * _distance("dx", "dy", "sx", "sy")
    order = F.struct(err.alias("err"), "sx", "sy", "ti")
    best = both.groupBy("encoding_id", "dx", "dy").agg(F.min_by(F.struct("sx", "sy", "ti", err.alias("err"), columns.total(F.col("r")).alias("rs"), columns.total(F.col("d")).alias("ds")), order).alias("m"))
    return best.select("encoding_id", "dx", "dy", "m.sx", "m.sy", F.col("m.ti").cast("int").alias("ti"), columns.brightness(F.col("m.rs"), F.col("m.ds"), g * g).alias("brightness"), "m.err")


def _distance(ax: str, ay: str, bx: str, by: str):
    sq = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return F.sqrt((sq(ax, bx) + sq(ay, by)).cast("double"))


def weights(encodings: DataFrame, images: DataFrame, g: int) -> DataFrame:
    """encoding_id, w1, w2 of every one-source encoding whose domain has a tile that isn't white."""
    e = encodings.select("encoding_id", "domain1", "range_img")
    t = ops.tiles(images, g)
    near = e.join(t.where(columns.not_white(F.col("d"))).withColumnRenamed("img_id", "domain1"), "domain1").groupBy("encoding_id").agg(F.min("dx").alias("nx"), F.min("dy").alias("ny"))
    far = e.join(t.drop("d").withColumnRenamed("img_id", "range_img"), "range_img").groupBy("encoding_id").agg(F.max("dx").alias("mx"), F.max("dy").alias("my"))
    return near.join(far, "encoding_id").select("encoding_id", F.lit(1).alias("w1"), (1.0 / (_distance("mx", "my", "nx", "ny") + EPS)).alias("w2"))


def decode(codes: DataFrame, sources: DataFrame, iterations: int = 5, clip: bool = False) -> DataFrame:
    """Images of every iteration: encoding_id, step (0: the first source), h, w, pixels (double).

    ``sources``: encoding_id, h, w (of the result), source1, source2 (structs
    h, w, pixels; source2 null: source1 again).  Sources of another size are
    resized.  All iterations of an encoding run in one place, so nothing is
    shuffled between them and lineage doesn't grow.
    """
    book = codes.groupBy("encoding_id").agg(F.collect_list(F.struct("dx", "dy", "sx", "sy", "ti", "contrast", "brightness", "comp", "grid")).alias("codes"))
    rows = sources.join(book, "encoding_id")

    def image(s, h: int, w: int) -> np.ndarray:
        x = np.asarray(s["pixels"], float).reshape(1, int(s["h"]), int(s["w"]))
        return x if x.shape[1:] == (h, w) else blocks.resize(x, (h, w)).astype(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for e, h, w, s1, s2, own in zip(*(b[c] for c in ("encoding_id", "h", "w", "source1", "source2", "codes")), strict=True):
                one = image(s1, h, w)
                two = one if s2 is None or s2["pixels"] is None else image(s2, h, w)
                steps = [one]
                parts: dict[tuple, list] = {}
                for c in own:
                    parts.setdefault((c["grid"], c["ti"], c["comp"]), []).append(c)
                for _ in range(iterations):
                    made = np.full((h, w), 255.0)
                    for (g, ti, x), some in parts.items():
                        cut = lambda img: np.stack([img[0, c["sx"] : c["sx"] + g, c["sy"] : c["sy"] + g] for c in some])  # noqa: B023, E731
                        d = blocks.transform(blocks.compose(cut(one), cut(two), x), ti)
                        for c, t in zip(some, d, strict=True):
                            made[c["dx"] : c["dx"] + g, c["dy"] : c["dy"] + g] = c["contrast"] * t + c["brightness"]
                    if clip:
                        made = np.clip(made, 0, 255)
                    one = two = made[None]
                    steps.append(one)
                yield pd.DataFrame({"encoding_id": e, "step": range(len(steps)), "h": h, "w": w, "pixels": [s[0].ravel() for s in steps]})

    return rows.mapInPandas(run, "encoding_id long, step int, h int, w int, pixels array<double>")


def decode_quality(decoded: DataFrame, targets: DataFrame, widths: int = 30) -> DataFrame:
    """CW-SSIM of every iteration with its target (encoding_id, pixels)."""
    both = decoded.join(targets.select("encoding_id", F.col("pixels").alias("_target")), "encoding_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, same in b.groupby(b["pixels"].map(len), sort=False):
                score = blocks.cw_ssim(np.stack(same["pixels"].to_numpy()), np.stack(same["_target"].to_numpy()).astype(float), widths)
                yield same[["encoding_id", "step"]].assign(score=score)

    return both.mapInPandas(run, "encoding_id long, step int, score double")


def chunks(df: DataFrame, order: str, n: int, buckets: int = 200) -> DataFrame:
    """Consecutive slices of n rows in the numeric column ``order``: adds chunk, from 0.

    Approximate quantiles part the rows into buckets; a row's rank is its rank
    in its bucket and the size of the buckets before.  No task sees all rows.
    """
    cuts = df.agg(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    own = df.withColumn("_b", F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>"), lambda c: c < F.col(order))))
    ranked = own.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1)
    sizes = own.groupBy("_b").count()
    before = sizes.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_n"))  # at most ``buckets`` rows
    return ranked.join(F.broadcast(before), "_b").withColumn("chunk", F.floor((F.col("_i") + F.col("_n")) / n)).drop("_b", "_i", "_n")
