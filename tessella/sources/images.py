"""Images as rows: img_id, h, w, pixels (row-major array of whole numbers, 0 black, 255 white)."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ITU-R 601 weights of red, green and blue in 16-bit fixed point.
_LUMA = (19595, 38470, 7471)

VARIANTS = {
    "grey": lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 512 * v.cast("double")))).cast("int"),
    "binary": lambda v: F.when(v < 0, 0).otherwise(255),
    "sparse": lambda v: F.when(v < -0.25, 0).otherwise(255),
}


def from_embeddings(vectors: DataFrame, variant: str = "grey", side: int = 8) -> DataFrame:
    """One side x side image of each vector; vectors that are null or of another length give none."""
    return vectors.where(F.size("embedding") == side * side).select(
        F.col("vec_id").alias("img_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), F.transform("embedding", VARIANTS[variant]).alias("pixels")
    )


def mosaics(images: DataFrame, side: int = 4) -> DataFrame:
    """side x side neighbouring images as one; incomplete ones are dropped."""
    n = side * side
    groups = images.groupBy(F.floor(F.col("img_id") / n).alias("m")).agg(F.sort_array(F.collect_list(F.struct("img_id", "pixels"))).alias("t"), F.first("w").alias("g"))
    whole = groups.where(F.size("t") == n)
    g = F.col("g")
    row = lambda y: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda c: F.slice(F.col("t")[(F.floor(y / g) * side + c).cast("int")]["pixels"], (y % g) * g + 1, g)))
    return whole.select(
        F.col("m").alias("img_id"), (g * side).alias("h"), (g * side).alias("w"),
        F.flatten(F.transform(F.sequence(F.lit(0), g * side - 1), row)).alias("pixels"),
    )


def explode_pixels(images: DataFrame) -> DataFrame:
    """(img_id, y, x, v), one row for each pixel."""
    p = images.select("img_id", "w", F.posexplode("pixels").alias("p", "v"))
    return p.select("img_id", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "v")


def implode_pixels(px: DataFrame) -> DataFrame:
    """Images from (img_id, y, x, v); every pixel must stand once."""
    return px.groupBy("img_id").agg(
        (F.max("y") + 1).cast("int").alias("h"), (F.max("x") + 1).cast("int").alias("w"),
        F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("pixels"),
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 luma in 16-bit fixed point, as image libraries convert colour to grey."""
    return F.shiftright(r * _LUMA[0] + g * _LUMA[1] + b * _LUMA[2] + 0x8000, 16)


def channels(n_channels: Column) -> Column:
    """1 for grey, 3 for colour; anything else is an error."""
    return F.when(n_channels.isin(1, 3), n_channels).otherwise(F.raise_error(F.lit("an image has 1 or 3 channels")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files (PNG, JPEG, GIF, BMP) in grey: img_id by path hash, origin, h, w, pixels.

    Files that cannot be decoded give no row.  Spark stores blue, green, red;
    a fourth channel is left out.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for origin, h, w, n, data in b.itertuples(index=False):
                x = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int32)
                grey = x[:, 0] if n < 3 else (x[:, 2] * _LUMA[0] + x[:, 1] * _LUMA[1] + x[:, 0] * _LUMA[2] + 0x8000) >> 16
                yield pd.DataFrame({"origin": [origin], "h": [h], "w": [w], "pixels": [grey]})

    return raw.mapInPandas(run, "origin string, h int, w int, pixels array<int>").select(F.xxhash64("origin").alias("img_id"), "origin", "h", "w", "pixels")


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG file of a (height, width) array; values outside 0..255 wrap."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape
    rows = np.zeros((h, w + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = pixels.astype(np.int64) & 255
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def to_png(images: DataFrame, *keep: str) -> DataFrame:
    """img_id, ``keep`` and ``content``: each image as the bytes of a PNG file.  Images without pixels give null."""
    names = ["img_id", *keep]
    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files = [png(np.asarray(p).reshape(int(h), int(w))) if p is not None and len(p) else None for h, w, p in zip(b["h"], b["w"], b["pixels"], strict=True)]
            yield b[names].assign(content=files)

    return images.select(*dict.fromkeys([*names, "h", "w", "pixels"])).mapInPandas(run, f"{kinds}, content binary")


def write_images(images: DataFrame, path: str) -> None:
    """A PNG file ``<img_id>.png`` in the folder ``path`` for each image, written by the executors.

    ``path`` is a folder that driver and executors share, by any URI that
    pyarrow's file systems know.  A task that runs again writes the same files;
    rows that repeat an img_id overwrite one another.
    """

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        system.create_dir(folder, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{folder}/{r.img_id}.png") as out:
                out.write(bytes(r.content))

    to_png(images).where("content is not null").foreachPartition(put)


def rgb_planes(images: DataFrame) -> DataFrame:
    """Images with a channel column c as separate grey images, and back with :func:`merge_planes`."""
    return images.select("img_id", "c", "h", "w", "pixels")


def merge_planes(planes: DataFrame) -> DataFrame:
    return planes.groupBy("img_id", "h", "w").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "pixels"))), lambda s: s["pixels"]).alias("planes"))


def write_codebook(codes: DataFrame, path: str) -> None:
    """Codebooks as Parquet, an extension."""
    codes.write.mode("overwrite").parquet(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
