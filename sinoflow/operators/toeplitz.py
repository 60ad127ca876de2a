"""The normal operator as a convolution: one transfer function for all slices, then two real FFTs a slice.

Back-projecting a projection is a convolution with the point spread of the angles, which depends on the angles and the
width alone. ``spread_rows`` sums it on executors, from a table of angles, as a table of rows; ``Stored`` is that table as
tasks read it from the shared folder, once a worker process ((2n - 1) x n complex numbers). ``transfer`` is the same on the
driver, for small widths. A slice then costs O(n^2 log n) where the direct sums cost O(P n^3).
"""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.container import filesystem
from . import arrays, nufft
from .gridding import Gridding
from .transforms import DIRECT, EPS, STEP, grid, per_slice, polar


def point_spread(theta, n: int) -> np.ndarray:
    """The waves of all samples summed, over lags -(n-1)..(n-1) in both axes."""
    m = 2 * n - 1
    x, y = polar(np.asarray(theta, float), n)
    lag = np.arange(m) - (n - 1)
    if n >= DIRECT:
        return Gridding(x, y, m, EPS).from_points(np.ones(len(x))).real
    spread = np.zeros((m, m))
    for k in range(0, len(x), STEP):
        ex, ey = (np.exp(1j * np.outer(v[k : k + STEP], lag)) for v in (x, y))
        spread += (ey.T @ ex).real
    return spread


def transfer(theta, n: int) -> np.ndarray:
    """The real FFT of the point spread, lag 0 in the corner."""
    return np.fft.rfft2(np.fft.ifftshift(point_spread(theta, n)))


def spread_rows(angles: DataFrame, n: int, eps: float = EPS) -> DataFrame:
    """The point spread of ``angles`` (proj_id, theta) as rows (slice_id 0, row_id, values): every sample is a point, its weight how often its angle occurs."""
    each = angles.groupBy("theta").agg(F.min("proj_id").alias("proj_id"), F.count(F.lit(1)).cast("double").alias("weight"))
    points = grid(each, n, "theta", "weight").select(F.lit(0).alias("slice_id"), F.xxhash64("theta", "col_id").alias("point_id"), "x", "y", F.col("weight").alias("re"), F.lit(0.0).alias("im"))
    return nufft.to_modes(points, 2 * n - 1, 2 * n - 1, eps).select("slice_id", "row_id", F.col("re").alias("values"))


class Stored:
    """The transfer function of a written table of ``spread_rows``: its files are read and transformed once in a worker process."""

    def __init__(self, rows: DataFrame) -> None:
        self.files = sorted(rows.inputFiles())

    @property
    def value(self) -> np.ndarray:
        import builtins

        known = builtins.__dict__.setdefault("_sinoflow_transfer", {})
        key = tuple(self.files)
        if key not in known:
            known.clear()
            lines = {}
            for file in self.files:
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    t = pq.read_table(f, columns=["row_id", "values"])
                lines |= {r: v.values.to_numpy() for r, v in zip(t["row_id"].to_pylist(), t["values"], strict=True)}
            known[key] = np.fft.rfft2(np.fft.ifftshift(np.stack([lines[r] for r in range(len(lines))])))
        return known[key]


def convolve(image: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """``image`` convolved with the point spread and scaled as the normal operator is."""
    n, m = image.shape[1], 2 * image.shape[1] - 1
    wide = np.fft.irfft2(np.fft.rfft2(image, s=(m, m)) * spread, s=(m, m))
    return wide[:n, :n] / n**3


def _shared(df: DataFrame, spread):
    """A broadcast of the transfer function; one that is already shared is used again."""
    return spread if isinstance(spread, Broadcast | Stored) else df.sparkSession.sparkContext.broadcast(spread)


def normal(images: DataFrame, spread) -> DataFrame:
    """The normal operator on each slice."""
    shared = _shared(images, spread)
    return per_slice(images, lambda x: convolve(x, shared.value))


def gradient(images: DataFrame, back: DataFrame, spread) -> DataFrame:
    """The data term's gradient, the back-projected sinogram subtracted."""
    return arrays.subtract(normal(images, spread), back)


def misfit(images: DataFrame, back: DataFrame, spread, norm: float) -> float:
    """``norm`` (the sinogram's sum of squares) + sum of x * (T x - 2 b): the squared misfit without a projection."""
    terms = arrays.zip_arrays(normal(images, spread), back, lambda t, b: t - b * 2)
    inner = arrays.multiply(images, terms)
    return norm + (inner.agg(arrays.total(inner)).first()[0] or 0.0)


def multiply_all(images: DataFrame, plane: np.ndarray) -> DataFrame:
    """Each slice times one plane, element by element; the plane is the size of one slice and is broadcast as rows."""
    rows = images.sparkSession.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(np.asarray(plane))], "_row int, _plane array<double>")
    met = images.join(F.broadcast(rows), F.col("row_id") == F.col("_row"))
    return met.select("slice_id", "row_id", F.zip_with("values", "_plane", lambda a, b: a * b).alias("values"))
