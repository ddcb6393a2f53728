"""Image arithmetic on arrays of grey values (numpy), and the Arrow functions that apply it to columns.

Decoding files needs a library that is plugged in: `decode` turns bytes into an array of rows x columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

Decode = Callable[[bytes], np.ndarray]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue; a grey image stays."""
    return image if image.ndim == 2 else image[..., :3] @ np.array([0.299, 0.587, 0.114])


def shrunk(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over a grid of cells."""
    a = np.linspace(0, image.shape[0], rows + 1).astype(int)
    b = np.linspace(0, image.shape[1], columns + 1).astype(int)
    return np.array([[image[a[i] : max(a[i + 1], a[i] + 1), b[j] : max(b[j + 1], b[j] + 1)].mean() for j in range(columns)] for i in range(rows)])


def packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()).view(">i8")[0])


def average_hash(image: np.ndarray) -> int:
    small = shrunk(grey(image), 8, 8)
    return packed(small > small.mean())


def difference_hash(image: np.ndarray) -> int:
    small = shrunk(grey(image), 8, 9)
    return packed(small[:, 1:] > small[:, :-1])


def perceptual_hash(image: np.ndarray) -> int:
    """The low frequencies of a cosine transform against their median."""
    small, k = shrunk(grey(image), 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    return packed(low > np.median(low))


def histogram_likeness(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Correlation, chi-square and intersection of 256-bin histograms scaled to a length of one."""
    x, y = (np.bincount(grey(i).astype(np.uint8).ravel(), minlength=256).astype(float) for i in (a, b))
    x, y = x / (np.linalg.norm(x) or 1), y / (np.linalg.norm(y) or 1)
    p, q = x - x.mean(), y - y.mean()
    scale = np.sqrt((p**2).sum() * (q**2).sum())
    return {"correlation": float((p * q).sum() / scale) if scale else 1.0, "chi_square": float(((x - y) ** 2)[x > 0] @ (1 / x[x > 0])), "intersection": float(np.minimum(x, y).sum())}


def _means(x: np.ndarray, size: int) -> np.ndarray:
    total = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def structural_likeness(a: np.ndarray, b: np.ndarray, size: int = 11) -> tuple[float, float, float]:
    """Mean structural similarity over windows, and the map's mean and deviation; both images are cut to the smaller extent."""
    n, m = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    x, y = (grey(i)[:n, :m].astype(float) for i in (a, b))
    size = min(size, n, m)
    scale = size**2 / max(size**2 - 1, 1)
    mx, my = _means(x, size), _means(y, size)
    vx, vy, cov = scale * (_means(x * x, size) - mx**2), scale * (_means(y * y, size) - my**2), scale * (_means(x * y, size) - mx * my)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    found = (2 * mx * my + c1) * (2 * cov + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))
    return float(found.mean()), float(found.mean()), float(found.std())


def scan_quality(image: np.ndarray) -> float:
    """Contrast, sharpness and lack of noise, weighed .4, .4 and .2, one at most."""
    x = grey(image).astype(float)
    inner = x[1:-1, 1:-1]
    edges = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * inner
    noise = np.abs(inner - (x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]) / 4).mean() / 255 if inner.size else 0.0
    sharp = min(edges.var() / 1e4, 1.0) if inner.size else 0.0
    return float(min(0.4 * x.std() / 255 + 0.4 * sharp + 0.2 * (1 - min(10 * noise, 1.0)), 1.0))


def hashes(decode: Decode):
    """A column function: image bytes to struct<phash, ahash, dhash>; null where an image can't be read."""

    def one(data: bytes | None) -> tuple[int | None, int | None, int | None]:
        try:
            image = decode(data) if data is not None else None
        except Exception:  # noqa: BLE001 a decoder's own errors mean no hash
            image = None
        return (None, None, None) if image is None else (perceptual_hash(image), average_hash(image), difference_hash(image))

    @F.pandas_udf("phash long, ahash long, dhash long")
    def apply(images: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in images], columns=["phash", "ahash", "dhash"], dtype="Int64")

    return apply
