"""Numerics on stacks of equally sized images, shape (n, height, width)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WHITE, BLACK, MIDDLE = 255, 0, 128

# Names in the order of their numbers.
TRANSFORM_NAMES = ("Identity", "Rotate90", "Rotate180", "Rotate270", "HorizontalFlip", "VerticalFlip", "ReflectYnX", "ReflectYX", "ShapeFiller", "ShapeUnfiller")
COMPLEXITIES = (0, 1, 1, 1, 2, 2, 3, 3, 5, 5)
UNFILL = 9
COMPOSITIONS = {0: "ImageCompIdentityLeft", 2: "ImageUnion", 3: "ImageIntersection", 4: "ImageSubtract", 5: "ImageBacksubtract", 6: "ImageXOR"}
# Horizontal 5x5 edge kernel; the vertical one is its negated transpose.
SOBEL = np.array([[-1, -2, 0, 2, 1], [-4, -8, 0, 8, 4], [-6, -12, 0, 12, 6], [-4, -8, 0, 8, 4], [-1, -2, 0, 2, 1]], float)


def correlate(x: np.ndarray, kernel: np.ndarray, mode: str = "constant", pad_value: float = WHITE) -> np.ndarray:
    """Same-size correlation; an even kernel has its extra cell above and to the left."""
    k = kernel.shape[0]
    pad = ((0, 0), (k // 2, (k - 1) // 2), (k // 2, (k - 1) // 2))
    padded = np.pad(x.astype(float), pad, mode=mode, **({"constant_values": pad_value} if mode == "constant" else {}))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(1, 2))
    return np.einsum("nyxab,ab->nyx", windows, kernel)


@lru_cache(maxsize=64)
def gaussian(size: int, sigma: float) -> np.ndarray:
    """Outer product of a normalised one-dimensional bell; an even size has no cell at its centre's distance 0."""
    side = np.linspace(-(size // 2), size // 2, size)
    bell = np.exp(-0.5 * (side / sigma) ** 2)
    bell /= bell.sum()
    return np.outer(bell, bell)


def blur(x: np.ndarray, size: int = 3, sigma: float = 3.0) -> np.ndarray:
    """Gaussian blur; whole-number images stay whole by truncation."""
    out = correlate(x, gaussian(size, float(sigma)))
    return np.trunc(out).astype(x.dtype) if np.issubdtype(x.dtype, np.integer) else out


def edges(x: np.ndarray, top: float = 255.0) -> np.ndarray:
    """Inverted edge strength: edges dark, each image scaled by its maximum."""
    size = np.sqrt(correlate(x, SOBEL) ** 2 + correlate(x, -SOBEL.T) ** 2)
    return 255 - size * top / (size.max(axis=(1, 2), keepdims=True) + 1e-6)


def fill(x: np.ndarray) -> np.ndarray:
    """Black where black pixels stand on all four sides (or on the pixel)."""
    dark = x < MIDDLE
    seen = np.ones_like(dark)
    for axis in (1, 2):
        seen &= np.logical_or.accumulate(dark, axis=axis)
        seen &= np.flip(np.logical_or.accumulate(np.flip(dark, axis), axis=axis), axis)
    return np.where(seen, BLACK, WHITE)


def unfill(x: np.ndarray) -> np.ndarray:
    """Black where a black pixel lies on an edge."""
    return np.where((x < MIDDLE) & (edges(x) < MIDDLE), BLACK, WHITE)


def transform(x: np.ndarray, ti: int) -> np.ndarray:
    if ti == 0:
        return x
    if ti in (1, 2, 3):
        return np.rot90(x, ti, axes=(1, 2))
    if ti == 4:
        return x[:, :, ::-1]
    if ti == 5:
        return x[:, ::-1, :]
    if ti == 6:
        return x[:, ::-1, ::-1].transpose(0, 2, 1)
    if ti == 7:
        return x.transpose(0, 2, 1)
    if ti == 8:
        return fill(x)
    if ti == UNFILL:
        return unfill(x)
    raise ValueError(f"no transform {ti}")


def translate(x: np.ndarray, tx: int, ty: int, constant: int = 0) -> np.ndarray:
    """Shift right by tx and down by ty, at most the whole size; what is left open is ``constant``."""
    n, h, w = x.shape
    tx, ty = max(-w, min(w, tx)), max(-h, min(h, ty))
    out = np.full_like(x, constant)
    ys, xs = slice(max(0, ty), h + min(0, ty)), slice(max(0, tx), w + min(0, tx))
    out[:, ys, xs] = x[:, max(0, -ty) : h - max(0, ty), max(0, -tx) : w - max(0, tx)]
    return out


def compose(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Two stacks into one; kind 1 (right identity) is not among the searched ones."""
    if kind == 0:
        return a
    if kind == 1:
        return b
    if kind == 2:
        dark = (a < MIDDLE) | (b < MIDDLE)
    elif kind == 3:
        dark = (a < MIDDLE) & (b < MIDDLE)
    elif kind == 4:
        dark = (a <= MIDDLE) & (b > MIDDLE)
    elif kind == 5:
        dark = (b <= MIDDLE) & (a > MIDDLE)
    elif kind == 6:
        dark = blur(np.where((a != 0) ^ (b != 0), 255, 0), 5, 1.0) > 90
    else:
        raise ValueError(f"no composition {kind}")
    return np.where(dark, BLACK, WHITE)


@lru_cache(maxsize=256)
def _ricker(width: int, points: int) -> np.ndarray:
    """Samples of the Mexican hat of a width, one apart, centred: the negative second derivative of a bell, of unit energy."""
    square = (np.linspace(-0.5, 0.5, points) * (points - 1) / width) ** 2
    unit = np.sqrt(4 / (3 * width * np.sqrt(np.pi)))
    return unit * np.exp(-square / 2) * (1 - square)


@lru_cache(maxsize=64)
def wavelet_matrices(n: int, widths: int) -> np.ndarray:
    """(widths, n, n): causal convolution with the wavelet of each width as a matrix."""
    out = np.zeros((widths, n, n))
    for w in range(1, widths + 1):
        wave = _ricker(w, min(10 * w, n))
        for k, v in enumerate(wave):
            out[w - 1] += v * np.eye(n, k=-k)
    return out


def cw_ssim_map(a: np.ndarray, b: np.ndarray, widths: int = 30, k: float = 0.01) -> np.ndarray:
    """Complex-wavelet structural similarity of each pair at each pixel, (n, pixels)."""
    x, y = a.reshape(len(a), -1).astype(float), b.reshape(len(b), -1).astype(float)
    prod, plain, xx, yy = (np.zeros_like(x) for _ in range(4))
    for m in wavelet_matrices(x.shape[1], widths):
        p, q = x @ m.T, y @ m.T
        plain += p * q
        prod += np.abs(p * q)
        xx += p * p
        yy += q * q
    return (2 * prod + k) / (xx + yy + k) * ((2 * np.abs(plain) + k) / (2 * prod + k))


def cw_ssim(a: np.ndarray, b: np.ndarray, widths: int = 30, k: float = 0.01) -> np.ndarray:
    """Complex-wavelet structural similarity of each pair."""
    return cw_ssim_map(a, b, widths, k).mean(axis=1)


def ssim_map(a: np.ndarray, b: np.ndarray, sigma: float = 1.0, top: float = 255.0) -> np.ndarray:
    """Structural similarity of each pair at each pixel: the luminance term times the contrast-structure term."""
    a, b = a.astype(float), b.astype(float)
    near = lambda z: blur(z, 3, sigma)
    mean_a, mean_b = near(a), near(b)
    both = mean_a * mean_b
    spread = near(a * a) - mean_a**2 + near(b * b) - mean_b**2
    small, large = ((f * top) ** 2 for f in (0.01, 0.03))
    luminance = (2 * both + small) / (mean_a**2 + mean_b**2 + small)
    structure = (2 * (near(a * b) - both) + large) / (spread + large)
    return luminance * structure


def ssim(a: np.ndarray, b: np.ndarray, window: int = 11, sigma: float = 1.0, top: float = 255.0) -> np.ndarray:
    """Structural similarity, mean over the centre; the window only sets the centre's size."""
    return crop(ssim_map(a, b, sigma, top), ((window - 1) // 2,) * 2).mean(axis=(1, 2))


def crop(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Centred window; of a larger size, the difference is cut off instead."""
    _, h, w = x.shape
    dy, dx = abs(h - size[0]), abs(w - size[1])
    return x[:, dy // 2 : h - (dy - dy // 2), dx // 2 : w - (dx - dx // 2)]


def image_tversky(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pixels outside the intersection over pixels outside the union: larger means less alike."""
    both = ((a < MIDDLE) & (b < MIDDLE)).sum(axis=(1, 2))
    any_ = ((a < MIDDLE) | (b < MIDDLE)).sum(axis=(1, 2))
    n = a.shape[1] * a.shape[2]
    return (n - both) / (n - any_ + 1e-6)


def square_error(a: np.ndarray, b: np.ndarray, wrap: bool) -> np.ndarray:
    d = (a.astype(np.int64) - b.astype(np.int64)) ** 2
    return (d & 255 if wrap else d).sum(axis=-1)


def brightness(r_sum: np.ndarray, d_sum: np.ndarray, n: int) -> np.ndarray:
    """floor(mean(R - 0.75 D)) within +-255, in whole numbers."""
    return np.clip((4 * r_sum - 3 * d_sum) // (4 * n), -255, 255)


def composition_score(metric: str, made: np.ndarray, target: np.ndarray, widths: int, wrap: bool) -> np.ndarray:
    """Higher is better for every metric."""
    metric = metric.lower()
    if metric == "cw_ssim":
        return cw_ssim(made, target, widths)
    if metric == "ssim":
        return ssim(made, target)
    if metric == "rmse":
        flat = lambda z: z.reshape(len(z), -1)
        return -np.sqrt(square_error(flat(made), flat(target), wrap)) / made[0].size
    if metric == "tversky":
        return image_tversky(made, target)
    raise ValueError("metric must be one of cw_ssim, ssim, rmse, tversky")


def best_composition(a: np.ndarray, b: np.ndarray, target: np.ndarray, widths: int = 5, metric: str = "cw_ssim", wrap: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, score and image of the best composition of each pair; the smallest number wins ties."""
    best = np.full(len(a), -np.inf)
    kind, image = np.zeros(len(a), np.int64), np.zeros(a.shape, np.int64)
    for x in COMPOSITIONS:
        made = compose(a, b, x).astype(np.int64)
        score = composition_score(metric, made, target, widths, x == 0 and bool(np.all(wrap)))
        score = np.round(score, 12)
        win = score > best
        best[win], kind[win], image[win] = score[win], x, made[win]
    return kind, -best if metric.lower() == "rmse" else best, image


def stack_tiles(x: np.ndarray, g: int) -> np.ndarray:
    """(n, tiles, g, g) of a stack in row-major order; remainders are dropped."""
    n, h, w = x.shape
    r, c = h // g, w // g
    return x[:, : r * g, : c * g].reshape(n, r, g, c, g).swapaxes(2, 3).reshape(n, r * c, g, g)


def tiles(x: np.ndarray, g: int) -> np.ndarray:
    """(tiles, g, g) of one image."""
    return stack_tiles(x[None], g)[0]


def label(x: np.ndarray) -> np.ndarray:
    """8-connected components of the nonzero pixels of one image, numbered by first pixel in raster order."""
    h, w = x.shape
    on = np.pad(x != 0, 1)
    big = (h + 2) * (w + 2)
    mark = np.where(on, np.arange(big).reshape(h + 2, w + 2), big)
    while True:
        low = mark.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                low[1:-1, 1:-1] = np.minimum(low[1:-1, 1:-1], mark[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx])
        low = np.where(on, low, big)
        flat = np.append(low.ravel(), big)
        low = np.where(on, flat[np.minimum(low, big)], big)  # pointer jumping
        if (low == mark).all():
            break
        mark = low
    roots = np.unique(mark[on])
    return np.where(on, np.searchsorted(roots, mark) + 1, 0)[1:-1, 1:-1]


def _bicubic_weights(n: int, m: int) -> np.ndarray:
    """(m, n) weights of an antialiased bicubic resize (a = -0.5)."""
    scale = n / m
    support = 2.0 * max(1.0, scale)
    out = np.zeros((m, n))
    for i in range(m):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support + 0.5)), min(n, int(centre + support + 0.5))
        t = np.abs((np.arange(lo, hi) - centre + 0.5) / max(1.0, scale))
        wgt = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))
        out[i, lo:hi] = wgt / wgt.sum()
    return out


def resize(x: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Bicubic, cast to 0..255 whole numbers first; the same size is left as it is."""
    _, h, w = x.shape
    if (h, w) == tuple(size):
        return x
    x = x.astype(np.int64) & 255
    whole = lambda z: np.clip(np.floor(np.round(z, 9) + 0.5), 0, 255)  # noqa: E731  halves go up, whatever order they were summed in
    wide = whole(np.einsum("nyx,mx->nym", x, _bicubic_weights(w, size[1])))
    return whole(np.einsum("nym,ky->nkm", wide, _bicubic_weights(h, size[0]))).astype(np.int64)
