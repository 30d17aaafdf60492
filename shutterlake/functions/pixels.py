"""Signatures from decoded pixels, in Arrow batches.

Inputs are arrays of grey or RGB values that are already scaled to the size a
signature wants, as no imaging library is assumed. Bit i of a hash is the i-th
pixel in row order, least significant first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits as signed 64-bit integers."""
    return np.packbits(bits.reshape(len(bits), -1), axis=1, bitorder="little").view("<i8").reshape(len(bits), -1)


def average_bits(grey: np.ndarray) -> np.ndarray:
    """8 x 8: brighter than the mean."""
    return grey > grey.mean(axis=(1, 2), keepdims=True)


def difference_bits(grey: np.ndarray) -> np.ndarray:
    """8 rows of 9: darker than the right neighbour."""
    return grey[:, :, :-1] < grey[:, :, 1:]


def block_bits(grey: np.ndarray) -> np.ndarray:
    """16 x 16: brighter than the median."""
    return grey > np.median(grey.reshape(len(grey), -1), axis=1)[:, None, None]


def cosine_bits(grey: np.ndarray, keep: int = 8) -> np.ndarray:
    """32 x 32: the lowest ``keep`` x ``keep`` frequencies, the constant one too, above their median."""
    n = grey.shape[1]
    basis = np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(keep)[:, None] / (2 * n))
    low = basis @ grey @ basis.T
    return low > np.median(low.reshape(len(low), -1), axis=1)[:, None, None]


def _hash_column(rows: int, columns: int, bits, wide: bool):
    def run(values: pd.Series) -> pd.Series:
        out: list = [None] * len(values)
        good = [k for k, v in enumerate(values) if v is not None and len(v) == rows * columns]
        if good:
            grey = np.stack([np.asarray(values.iloc[k], float).reshape(rows, columns) for k in good])
            for k, packed in zip(good, pack(bits(grey))):
                out[k] = packed.tolist() if wide else int(packed[0])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<bigint>" if wide else "bigint")


def average_hash(grey: Column) -> Column:
    """aHash of 64 grey values; null for any other number of values."""
    return _hash_column(8, 8, average_bits, False)(grey)


def difference_hash(grey: Column) -> Column:
    """dHash of 8 rows of 9 grey values."""
    return _hash_column(8, 9, difference_bits, False)(grey)


def perceptual_hash(grey: Column) -> Column:
    """pHash of 32 x 32 grey values."""
    return _hash_column(32, 32, cosine_bits, False)(grey)


def block_hash(grey: Column) -> Column:
    """bHash of 16 x 16 grey values as four bigints."""
    return _hash_column(16, 16, block_bits, True)(grey)


def color_counts(rgb: np.ndarray) -> list[int]:
    """16 hues x 4 saturations in thousandths of the pixels that aren't dark; zeros if all are."""
    pixels = rgb.reshape(-1, 3).astype(float)
    top, low = pixels.max(1), pixels.min(1)
    span = np.where(top > low, top - low, 1)
    r, g, b = pixels.T
    hue = np.where(top == r, (g - b) / span % 6, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4)) / 6 * 255
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0) * 255
    lit = top >= 12
    if not lit.any():
        return [0] * 64
    cell = np.minimum(15, hue[lit].astype(int) * 16 // 256) * 4 + np.minimum(3, saturation[lit].astype(int) * 4 // 256)
    counts = np.bincount(cell, minlength=64)
    return [round(1000 * int(c) / int(lit.sum())) for c in counts]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def color_signature(rgb: pd.Series) -> pd.Series:
    """Colour signature of RGB values in a row; null unless they come in threes."""
    return pd.Series([color_counts(np.asarray(v)) if v is not None and len(v) and len(v) % 3 == 0 else None for v in rgb], dtype=object)


@F.pandas_udf(T.StringType())
def pixel_digest(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """SHA-256 of the dimensions and RGBA bytes, so that only the picture counts; null if they don't fit."""
    out = []
    for data, w, h in zip(rgba, width, height):
        fits = data is not None and pd.notna(w) and pd.notna(h) and len(data) == 4 * int(w) * int(h)
        out.append(hashlib.sha256(f"{int(w)}x{int(h)}:RGBA:".encode() + bytes(data)).hexdigest() if fits else None)
    return pd.Series(out, dtype=object)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation; 0 for flat patches."""
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / size) if size > 1e-6 else 0.0


def best_crop(big: np.ndarray, small: np.ndarray, least: float = 0.82, aspect: float | None = None) -> tuple[float, int, int, int, int] | None:
    """(score, x, y, width, height): where in the 32 x 32 block means of a picture another fits best, in cells.

    The smaller picture is brought to every width from 7 to 32 cells at its own
    aspect (that of its values unless given) by block means and slid over the bigger one. Null below ``least``,
    or if it covers more than 92 % both ways.
    """
    rows, columns = big.shape
    best: tuple[float, int, int, int, int] | None = None
    for w in range(7, columns + 1):
        h = round(w / (aspect or small.shape[1] / small.shape[0]))
        if h < 7 or h > rows:
            continue
        ys, xs = np.linspace(0, small.shape[0], h + 1).astype(int), np.linspace(0, small.shape[1], w + 1).astype(int)
        total = np.zeros((small.shape[0] + 1, small.shape[1] + 1))
        total[1:, 1:] = small.cumsum(0).cumsum(1)
        y0, y1, x0, x1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1), xs[:-1], np.maximum(xs[1:], xs[:-1] + 1)
        y1, x1 = np.minimum(y1, small.shape[0]), np.minimum(x1, small.shape[1])
        patch = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / np.maximum((y1 - y0)[:, None] * (x1 - x0)[None, :], 1)
        windows = np.lib.stride_tricks.sliding_window_view(big, (h, w))
        centred = windows - windows.mean(axis=(2, 3), keepdims=True)
        flat = patch - patch.mean()
        size = np.sqrt((centred**2).sum(axis=(2, 3)) * (flat**2).sum())
        scores = np.where(size > 1e-6, (centred * flat).sum(axis=(2, 3)) / np.where(size > 1e-6, size, 1), 0)
        y, x = np.unravel_index(scores.argmax(), scores.shape)
        if best is None or scores[y, x] > best[0]:
            best = (float(scores[y, x]), int(x), int(y), w, h)
    if best is None or best[0] < least or (best[3] > 0.92 * columns and best[4] > 0.92 * rows):
        return None
    return best
