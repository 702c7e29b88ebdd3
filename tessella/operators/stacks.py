"""Running numpy functions on images that stand in rows, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_stacks(df: DataFrame, f: Callable[..., dict], columns: list[str], returns: str, keep: list[str], args: tuple = ()) -> DataFrame:
    """``keep`` columns and what ``f`` returns for stacks of the pixel ``columns``.

    ``f(stack, ..., *args)`` gets arrays (n, h, w) of rows of one shape (all
    pixel columns of a row have the shape h, w) and returns one sequence of
    length n for each name of ``returns``, a DDL string.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [x.strip().split()[0].strip("`") for x in returns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (h, w), part in b.groupby(["h", "w"], sort=False):
                for at in range(0, len(part), 2_000):
                    some = part.iloc[at : at + 2_000]
                    stacks = [np.stack(some[c].to_numpy()).astype(np.int64).reshape(len(some), h, w) for c in columns]
                    made = f(*stacks, *args)
                    yield some[keep].assign(**{n: list(made[n]) for n in names})

    return df.select(*dict.fromkeys([*keep, "h", "w", *columns])).mapInPandas(run, f"{kinds}, {returns}")


def flat(x: np.ndarray) -> list[np.ndarray]:
    return list(x.reshape(len(x), -1))
