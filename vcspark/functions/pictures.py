"""Hashes, sharpness, differences and an embedding of raw RGB pictures (three bytes a pixel, row by row).

Pandas UDFs over Arrow batches; each picture is a few array operations. Luminance is
summed in whole thousandths, so cells of a flat picture are exactly equal. A picture is
null, or of no use, if its bytes don't fill width times height pixels: its result is null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of red, green and blue in thousandths; levels of gradient that count as sharp.
LUMA = np.array([299, 587, 114])
SHARP_GRADIENT = 32
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])


def _pixels(raw: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    """Rows x columns x channels."""
    if raw is None or width is None or height is None or width != width or height != height:
        return None
    w, h = int(width), int(height)
    return np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(np.int64) if w > 0 and h > 0 and len(raw) == 3 * w * h else None


def _region(picture: np.ndarray, box: dict | None) -> np.ndarray:
    """The part inside a box in shares of the picture, one pixel at least; all of it without a box."""
    if box is None or any(box[c] is None or box[c] != box[c] for c in ("x", "y", "width", "height")):
        return picture
    h, w = picture.shape[:2]
    left, top = (min(max(0, int(np.floor(box[c] * n))), n - 1) for c, n in (("x", w), ("y", h)))
    right = max(left + 1, min(w, int(np.ceil((box["x"] + box["width"]) * w))))
    bottom = max(top + 1, min(h, int(np.ceil((box["y"] + box["height"]) * h))))
    return picture[top:bottom, left:right]


@lru_cache(maxsize=4096)
def _edges(length: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last bound of each cell: cells of less than a pixel share it."""
    at = np.arange(cells)
    start = at * length // cells
    return start, np.minimum(length, np.maximum(start + 1, -(-(at + 1) * length // cells)))


def _cells(plane: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each of ``rows`` x ``columns`` cells."""
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.cumsum(axis=0).cumsum(axis=1)
    (top, bottom), (left, right) = _edges(plane.shape[0], rows), _edges(plane.shape[1], columns)
    both = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    return both / np.outer(bottom - top, right - left)


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def _gradient_bits(picture: np.ndarray) -> np.ndarray:
    grey = _cells(picture @ LUMA, 8, 9)
    return grey[:, :-1] > grey[:, 1:]


def _each(kernel, *columns: pd.Series) -> list:
    """``kernel`` of each usable picture and what belongs to it, null for the others."""
    raw, width, height, *more = columns
    pictures = (_pixels(*p) for p in zip(raw, width, height))
    return [None if p is None else kernel(p, *rest) for p, *rest in zip(pictures, *more)]


def _boxes(box: pd.DataFrame) -> pd.Series:
    return pd.Series(box.to_dict("records"))


@F.pandas_udf(T.StringType())
def difference_hash(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """dHash: whether each of 8 x 9 cells is brighter than its right neighbour, 16 hex digits."""
    return pd.Series(_each(lambda p: _hex(_gradient_bits(p)), rgb, width, height))


def _brighter(picture: np.ndarray, box: dict | None = None) -> str:
    grey = _cells(_region(picture, box) @ LUMA, 8, 8)
    return _hex(grey > grey.mean())


@F.pandas_udf(T.StringType())
def average_hash(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """aHash: whether each of 8 x 8 cells is brighter than their mean, 16 hex digits."""
    return pd.Series(_each(_brighter, rgb, width, height))


@F.pandas_udf(T.StringType())
def region_hash(rgb: pd.Series, width: pd.Series, height: pd.Series, box: pd.DataFrame) -> pd.Series:
    """aHash of the part inside a box (x, y, width, height in shares); of the whole picture where a side is null."""
    return pd.Series(_each(_brighter, rgb, width, height, _boxes(box)))


def _sharp(picture: np.ndarray, box: dict | None) -> float:
    grey = _region(picture, box) @ LUMA
    inner = grey[:-1, :-1]
    if not inner.size:
        return 0.0
    total = np.abs(grey[:-1, 1:] - inner).sum() + np.abs(grey[1:, :-1] - inner).sum()
    return min(1.0, float(total) / 1000 / (2 * inner.size) / SHARP_GRADIENT)


@F.pandas_udf(T.DoubleType())
def region_sharpness(rgb: pd.Series, width: pd.Series, height: pd.Series, box: pd.DataFrame) -> pd.Series:
    """Mean step of luminance to the right and downwards inside a box, 0 to 1; 0 for a single row or column."""
    return pd.Series(_each(_sharp, rgb, width, height, _boxes(box)), dtype="float64")


@F.pandas_udf(T.DoubleType())
def picture_difference(a: pd.Series, a_width: pd.Series, a_height: pd.Series, b: pd.Series, b_width: pd.Series, b_height: pd.Series) -> pd.Series:
    """Mean absolute difference of two pictures, 0 to 1; 1 if they differ in size, null if one of them is of no use."""

    def one(x: np.ndarray | None, y: np.ndarray | None) -> float | None:
        if x is None or y is None:
            return None
        return 1.0 if x.shape != y.shape else float(np.abs(x - y).sum()) / (255 * x.size)

    return pd.Series([one(_pixels(*x), _pixels(*y)) for x, y in zip(zip(a, a_width, a_height), zip(b, b_width, b_height))], dtype="float64")


def _embedded(picture: np.ndarray) -> list[float]:
    bits = _gradient_bits(picture).ravel()[::-1]  # from the last bit of the hash
    pairs = bits[0::2] + 2 * bits[1::2]
    small = np.stack([np.floor(_cells(picture[:, :, c], 32, 32) + 0.5) for c in range(3)], axis=-1).astype(np.int64)
    light = (small @ LUMA + 500) // 1000
    bands = [np.bincount(np.minimum(7, plane.ravel() >> 5), minlength=8) / 1024 for plane in (*np.moveaxis(small, -1, 0), light)]
    vector = np.concatenate([(pairs - 1.5) / 1.5, *bands])
    return (vector / np.sqrt((vector * vector).sum())).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def picture_embedding(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64 dimensions of length 1: pairs of the dHash's bits, and shares of 8 bands of red, green, blue and luminance."""
    return pd.Series(_each(_embedded, rgb, width, height))
