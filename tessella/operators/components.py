"""Connected components of the pixels of each image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from .stacks import map_stacks


def label_components(images: DataFrame) -> DataFrame:
    """Images whose nonzero pixels are numbered by 8-connected component, in raster order of first pixels.

    An image is labelled where it stands; labels propagate through numpy
    minima and pointer jumping, so there is no shuffle.
    """
    f = lambda x: {"labels": [blocks.label(i).ravel().astype(np.int32) for i in x]}
    return map_stacks(images, f, ["pixels"], "labels array<int>", ["img_id", "h", "w"])


def component_sets(labelled: DataFrame) -> DataFrame:
    """(img_id, label, n_pixels, positions): each component with its pixel positions."""
    p = labelled.select("img_id", F.posexplode("labels").alias("p", "label")).where("label > 0")
    return p.groupBy("img_id", "label").agg(F.count("*").alias("n_pixels"), F.sort_array(F.collect_list("p")).alias("positions"))


def neighbour_labels(labelled: DataFrame) -> DataFrame:
    """(img_id, y, x, neighbours): distinct positive labels west, north, north-west and north-east of each pixel."""
    p = labelled.select("img_id", "h", "w", "labels", F.posexplode("labels").alias("p", "own"))
    y, x = F.floor(F.col("p") / F.col("w")).cast("int"), (F.col("p") % F.col("w"))
    look = lambda dy, dx: F.when((y + dy >= 0) & (x + dx >= 0) & (x + dx < F.col("w")), F.get("labels", (F.col("p") + dy * F.col("w") + dx).cast("int")))
    around = F.array(look(0, -1), look(-1, 0), look(-1, -1), look(-1, 1))
    return p.select("img_id", y.alias("y"), x.alias("x"), F.array_sort(F.array_distinct(F.filter(around, lambda v: v > 0))).alias("neighbours"))
