"""Pictures as grids: luma, bicubic reduction to 8 x 8, mean hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Weights of red, green and blue; sharpness of the cubic kernel.
LUMA = (0.299, 0.587, 0.114)
SHARPNESS = -0.5
SIDE = 8


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel, 0 from a distance of 2."""
    x, a = np.abs(x), SHARPNESS
    near = (a + 2) * x**3 - (a + 3) * x**2 + 1
    far = a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def reduction(n: int, side: int = SIDE) -> np.ndarray:
    """side x n: weights of ``n`` points in each of ``side`` new ones. The kernel is
    as wide as a new point (so each old one counts); weights outside the
    picture go to none, and every row's sum is 1."""
    scale = max(1.0, n / side)
    centres = (np.arange(side) + 0.5) * n / side
    weights = cubic((np.arange(n)[None, :] + 0.5 - centres[:, None]) / scale)
    return weights / weights.sum(axis=1, keepdims=True)


def mean_hashes(grids: np.ndarray) -> np.ndarray:
    """Per picture (rows x height x width) the bits, lowest first and row by row,
    of points of the reduced grid above its mean, as a signed number."""
    _, h, w = grids.shape
    small = np.einsum("ih,nhw,jw->nij", reduction(h), grids, reduction(w), optimize=True).reshape(len(grids), -1)
    # sums of equal points differ in their last digits
    bits = small > small.mean(axis=1, keepdims=True) + 1e-9
    return (bits.astype(np.uint64) << np.arange(SIDE * SIDE, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def picture_hashes(pictures: DataFrame, key: str = "id") -> DataFrame:
    """``(key, hash)`` of ``pictures`` (key, width, height, pixels: luma row by row,
    or red, green and blue of each point in turn).

    Pictures whose pixels are null or do not fill width x height have hash 0, as
    have those of one colour. Those of one size in a batch are reduced by two
    matrix products together.
    """
    kind = pictures.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            width, height = (np.array([x or 0 for x in batch.column(c).to_pylist()], np.int64) for c in ("width", "height"))
            pixels = batch.column("pixels")
            size = np.array([x or 0 for x in pa.compute.list_value_length(pixels).to_pylist()], np.int64)
            out = np.zeros(batch.num_rows, np.int64)
            for shape in set(zip(width.tolist(), height.tolist(), size.tolist())):
                w, h, n = shape
                if w < 1 or h < 1 or n not in (w * h, 3 * w * h):
                    continue
                rows = np.flatnonzero((width == w) & (height == h) & (size == n))
                values = np.asarray(pixels.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), h, w, -1)
                out[rows] = mean_hashes(values[..., 0] if n == w * h else values @ np.array(LUMA))
            yield pa.record_batch([batch.column(key), pa.array(out)], [key, "hash"])

    return pictures.select(key, "width", "height", "pixels").mapInArrow(run, f"`{key}` {kind}, hash long")
