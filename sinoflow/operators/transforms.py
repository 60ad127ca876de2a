"""Projection and back-projection: Arrow-batched NumPy kernels over whole slices.

A slice is the unit of work. Its non-uniform Fourier transform is gridded (``gridding``) to the tolerance ``EPS`` from
``DIRECT`` columns on, in O(samples + n^2 log n); smaller ones are summed directly, separated by axis, in blocks of
``STEP`` samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .gridding import Gridding

ROWS = "slice_id int, row_id int, values array<double>"


def grid(angles: DataFrame, n: int, *more: str) -> DataFrame:
    """(proj_id, col_id, x, y): the polar samples of ``angles`` (proj_id, theta), as native expressions, with columns of ``angles`` that are asked for."""
    r = (F.col("col_id") - n // 2) * F.lit(2 * np.pi / (n - 1))
    every = angles.select(*dict.fromkeys(("proj_id", "theta", *more)), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col_id"))
    return every.select("proj_id", "col_id", (F.cos("theta") * r).alias("x"), (F.sin("theta") * r).alias("y"), *more)


def polar(theta: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = 2 * np.pi / (n - 1) * (np.arange(n) - n // 2)
    return np.outer(np.cos(theta), r).ravel(), np.outer(np.sin(theta), r).ravel()


#: Columns from which transforms are gridded, to what tolerance, and samples of a direct sum that are in memory at a time.
DIRECT, EPS, STEP = 128, 1e-12, 4096


def _blocks(theta: np.ndarray, n: int, sign: int):
    x, y = polar(theta, n)
    k = np.arange(n) - n // 2
    for lo in range(0, len(x), STEP):
        own = slice(lo, lo + STEP)
        yield own, np.exp(sign * 1j * np.outer(x[own], k)), np.exp(sign * 1j * np.outer(y[own], k))


def to_polar(image: np.ndarray, theta: np.ndarray, eps: float | None = None) -> np.ndarray:
    """The image's Fourier transform at the polar samples, a row an angle. ``eps`` 0: summed directly."""
    n = image.shape[1]
    if n >= DIRECT and eps != 0:
        return Gridding(*polar(theta, n), n, eps or EPS).to_points(image).reshape(len(theta), -1)
    out = np.zeros(len(theta) * n, complex)
    for own, ex, ey in _blocks(theta, n, -1):
        out[own] = ((ey @ image) * ex).sum(1)
    return out.reshape(len(theta), -1)


def from_polar(spectrum: np.ndarray, theta: np.ndarray, eps: float | None = None) -> np.ndarray:
    """The adjoint: waves of all samples summed on the image's grid."""
    n, values = spectrum.shape[1], spectrum.reshape(-1)
    if n >= DIRECT and eps != 0:
        return Gridding(*polar(theta, n), n, eps or EPS).from_points(values)
    out = np.zeros((n, n), complex)
    for own, ex, ey in _blocks(theta, n, 1):
        out += ey.T @ (values[own, None] * ex)
    return out


def project_slice(image: np.ndarray, theta: np.ndarray) -> np.ndarray:
    n = image.shape[1]
    f = np.fft.ifft(np.fft.ifftshift(to_polar(image, theta), axes=1), axis=1) * n
    return np.fft.fftshift(f, axes=1).real / n**2


def backproject_slice(sino: np.ndarray, theta: np.ndarray, filtered: bool = False) -> np.ndarray:
    n = sino.shape[1]
    f = np.fft.fftshift(np.fft.fft(np.fft.ifftshift(sino, axes=1), axis=1), axes=1)
    if filtered:
        f = f * (np.abs(np.arange(n) - n // 2) / n)
    return from_polar(f, theta).real / n**2


def normal_slice(image: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return from_polar(to_polar(image, theta), theta).real / image.shape[1] ** 3


def per_slice(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` on each slice's matrix; one slice is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        out = kernel(np.stack(pdf["values"].to_list()))
        return pd.DataFrame({"slice_id": int(pdf["slice_id"].iloc[0]), "row_id": np.arange(len(out)), "values": list(out)})

    return df.groupBy("slice_id").applyInPandas(run, ROWS)


def _check(theta: np.ndarray | None) -> np.ndarray | None:
    return None if theta is None else np.asarray(theta, float)


def even_angles(n: int) -> np.ndarray:
    return np.arange(n) * np.pi / n


def project(images: DataFrame, theta) -> DataFrame:
    return per_slice(images, lambda x, t=_check(theta): project_slice(x, t))


def backproject(sino: DataFrame, theta=None, filtered: bool = False) -> DataFrame:
    """Without angles, each slice's rows lie evenly in [0, pi)."""
    return per_slice(sino, lambda y, t=_check(theta): backproject_slice(y, even_angles(len(y)) if t is None else t, filtered))


def gradient(images: DataFrame, back: DataFrame, theta) -> DataFrame:
    return arrays.subtract(per_slice(images, lambda x, t=_check(theta): normal_slice(x, t)), back)


def error(images: DataFrame, sino: DataFrame, theta) -> float:
    return arrays.squared_difference(project(images, theta), sino).first()[0] or 0.0
