"""Column expressions on images stored as row-major arrays of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel(v: Column) -> Column:
    """A pixel outside 0..255 wraps, as a cast to an unsigned byte does."""
    return v.cast("int").bitwiseAND(255)


def not_white(pixels: Column) -> Column:
    """At least one pixel of 128 or less."""
    return F.exists(pixels, lambda v: v <= 128)


def whitespace_area(pixels: Column) -> Column:
    return F.size(F.filter(pixels, lambda v: v > 10)).cast("long")


def whitespace_ratio(pixels: Column) -> Column:
    return whitespace_area(pixels) / F.size(pixels)


def checksum(pixels: Column) -> Column:
    """Sum of each pixel times its position from 1."""
    return F.aggregate(F.transform(pixels, lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)


def total(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v)


def permutation(ti: int, n: int) -> list[int]:
    """Source position of every pixel of an n x n block under transform 0..7."""
    m = n - 1
    gather = {
        0: lambda i, j: (i, j),
        1: lambda i, j: (j, m - i),
        2: lambda i, j: (m - i, m - j),
        3: lambda i, j: (m - j, i),
        4: lambda i, j: (i, m - j),
        5: lambda i, j: (m - i, j),
        6: lambda i, j: (m - j, m - i),
        7: lambda i, j: (j, i),
    }[ti]
    return [y * n + x for i in range(n) for j in range(n) for y, x in [gather(i, j)]]


def permuted(pixels: Column, ti: int, n: int) -> Column:
    return F.transform(F.array(*[F.lit(k) for k in permutation(ti, n)]), lambda k: pixels[k])


_DARK = {
    "ImageUnion": lambda a, b: (a < 128) | (b < 128),
    "ImageIntersection": lambda a, b: (a < 128) & (b < 128),
    "ImageSubtract": lambda a, b: (a <= 128) & (b > 128),
    "ImageBacksubtract": lambda a, b: (b <= 128) & (a > 128),
}


def composed(a: Column, b: Column, name: str) -> Column:
    """Pixelwise compositions without blur: identities, union, intersection, differences."""
    if name == "ImageCompIdentityLeft":
        return a
    if name == "ImageCompIdentityRight":
        return b
    dark = _DARK[name]
    return F.zip_with(a, b, lambda x, y: F.when(dark(x, y), 0).otherwise(255))


def square_error(a: Column, b: Column, wrap: bool = True) -> Column:
    """Sum of squared differences; ``wrap``: each modulo 256, as unsigned bytes have it."""
    term = (lambda x, y: ((x - y) * (x - y)).bitwiseAND(255)) if wrap else (lambda x, y: (x - y) * (x - y))
    return total(F.zip_with(a, b, term))


def brightness(r_sum: Column, d_sum: Column, n: Column | int) -> Column:
    floor = F.floor((4 * r_sum - 3 * d_sum).cast("double") / (4 * n))
    return F.greatest(F.lit(-255), F.least(F.lit(255), floor)).cast("int")


def tile(pixels: Column, width: Column, dx: Column, dy: Column, g: int) -> Column:
    """g x g pixels whose first row is dx and first column dy."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(g - 1)), lambda r: F.slice(pixels, (dx + r) * width + dy + 1, g)))


def brightness_bin(b: Column) -> Column:
    """``(lo, hi)`` of the bin that holds b: -255, -240, -220, .., 220, 255; left open, right closed."""
    hi = (F.ceil(b / 20.0) * 20).cast("int")
    lo = F.when(b <= -240, -255).when(b > 220, 220).otherwise(hi - 20)
    return F.format_string("(%d, %d)", lo.cast("int"), F.when(b <= -240, -240).when(b > 220, 255).otherwise(hi).cast("int"))
