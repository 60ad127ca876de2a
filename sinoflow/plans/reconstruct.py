"""Whole reconstructions: centre and pad, transform or solve, crop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrays as A
from ..operators import chunked, toeplitz
from ..operators import transforms as T
from . import optimize

Save = Callable[[DataFrame, str], DataFrame]


def _width(df: DataFrame) -> int:
    return df.select(F.size("values")).first()[0]


def prepare(sino: DataFrame, center: float) -> tuple[DataFrame, int]:
    """The centred sinogram with an odd number of columns, and the odd number of columns it had before the padding."""
    odd = A.odd_columns(sino)
    n = _width(odd)
    return A.recentre(odd, n, center), n


def crop(images: DataFrame, pixels: int) -> DataFrame:
    """Slices cropped about their middle to ``pixels`` rows and columns (one more where the surplus is odd)."""
    wide = _width(images)
    return A.crop_image(images, 2 * ((wide - pixels) // 2), wide)


def prepare_slice(sino: np.ndarray, center: float) -> np.ndarray:
    """As ``prepare``, on the matrix of one slice."""
    n = (sino.shape[1] - 1) | 1
    off, pad = A.centre(n, center)
    return np.roll(np.pad(sino[:, :n], ((0, 0), (pad, pad))), -off, axis=1)


def crop_slice(image: np.ndarray, pixels: int) -> np.ndarray:
    """As ``crop``, on the matrix of one slice."""
    k = (len(image) - pixels) // 2
    return image[k : len(image) - k, k : len(image) - k]


def _reconstruct(sino: DataFrame, theta, center: float, filtered: bool) -> DataFrame:
    padded, n = prepare(sino, center)
    return crop(T.backproject(padded, np.asarray(theta, float), filtered), n)


def fbp(sino: DataFrame, theta, center: float) -> DataFrame:
    """Filtered back-projection about ``center``."""
    return _reconstruct(sino, theta, center, True)


def adjoint(sino: DataFrame, theta, center: float) -> DataFrame:
    """Back-projection without the filter about ``center``."""
    return _reconstruct(sino, theta, center, False)


def circular_mask(images: DataFrame, ratio: float = 1.0, value: float = 0.0) -> DataFrame:
    """``value`` outside the circle of ``ratio`` times half a slice's width, as native expressions."""
    n = F.size("values")
    middle = (n - 1) / 2
    far = lambda k: F.pow(k - middle, F.lit(2)) + F.pow(F.col("row_id") - middle, F.lit(2))
    inside = F.transform("values", lambda v, k: F.when(far(k) <= F.pow(n * F.lit(ratio) / 2, F.lit(2)), v).otherwise(F.lit(value)))
    return images.select("slice_id", "row_id", inside.alias("values"))


@dataclass(frozen=True)
class Solved:
    """The images, the misfit after each iteration, and why it ended."""

    images: DataFrame
    errors: list[float]
    ended: str


def lipschitz_step(spark: SparkSession, n: int, normal: Callable[[np.ndarray], np.ndarray]) -> float:
    """1 over the greatest value of the normal operator on a slice of ones, 1 at most; the slice is a table's."""
    ones = spark.range(n).select(F.lit(0).alias("slice_id"), F.col("id").cast("int").alias("row_id"), F.array_repeat(F.lit(1.0), n).alias("values"))
    top = T.per_slice(ones, normal).agg(F.max(F.array_max("values"))).first()[0] or 0.0
    return min(1.0, 1 / top) if top > 0 else 1.0


def normal_of(theta: np.ndarray, n: int, spread=None) -> Callable[[np.ndarray], np.ndarray]:
    """The normal operator on one slice, as tasks apply it: by the transfer function ``spread`` (shared or stored), or direct."""
    return (lambda x: toeplitz.convolve(x, spread.value)) if spread is not None else (lambda x: T.normal_slice(x, theta))


class Fused:
    """The reconstruction as a problem for the optimizer, a step being one pass over the iterates and a sum over its rows.

    The normal operator N is linear, so a table that carries x, N x, s and N s beside each other gives N y by arithmetic; the
    only operator that a step applies is that on its gradient, which gives N of the candidate too. Misfits are
    norm + x * (N x - 2 b), with b the back-projected sinogram. Slices come in chunks with their border slices for the prior;
    of those only x and s are sent.
    """

    COLUMNS = ("x", "nx", "s", "ns", "b")
    SUMS = ("fx", "fy", "gg", "dd", "ss")
    SCHEMA = "slice_id int, row_id int, " + ", ".join(f"{c} array<double>" for c in COLUMNS) + ", " + ", ".join(f"{c} double" for c in SUMS)

    def __init__(self, back: DataFrame, norm: float, normal: Callable[[np.ndarray], np.ndarray], sigma: float, p: float, save: Save, curvature: bool = False, parts: int | None = None) -> None:
        self.back, self.norm, self.normal, self.sigma, self.p, self.save = back, norm, normal, sigma, p, save
        self.more = sum(w for *_, w in A.weights()) * A.prior_curvature(sigma) if curvature else 0.0
        self.parts, self.k, self.slices = parts, 0, 0

    def _saved(self, df: DataFrame) -> tuple[DataFrame, str]:
        name = f"step{self.k}"
        self.k += 1
        return self.save(df, name), name

    def begin(self, start: DataFrame) -> tuple:
        x = start.select("slice_id", "row_id", "values")
        n = T.per_slice(x, self.normal)
        of = lambda df, name: df.select(F.col("slice_id").cast("int").alias("slice_id"), F.col("row_id").cast("int").alias("row_id"), F.col("values").alias(name))
        met = of(x, "x").join(of(n, "nx"), ["slice_id", "row_id"]).join(of(self.back, "b"), ["slice_id", "row_id"], "left")
        b = F.coalesce("b", F.transform("x", lambda v: F.lit(0.0)))
        state = self._saved(met.select("slice_id", "row_id", "x", "nx", F.col("x").alias("s"), F.col("nx").alias("ns"), b.alias("b"), *(F.lit(0.0).alias(c) for c in self.SUMS)))
        self.slices = int(A.dims(state[0].withColumnRenamed("x", "values")).first()["slices"] or 0)
        return state

    def step(self, state: tuple, beta: float, step: float, base: str = "s", keep: str = "x") -> tuple:
        df, name = state
        sigma, p, more, normal = self.sigma, self.p, self.more, self.normal
        parts = min(self.slices, self.parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        met = A.chunks(df.select("slice_id", "row_id", *self.COLUMNS), self.slices, max(1, parts), 1)
        light = met.select("chunk_id", "ghost", "slice_id", "row_id", "x", "s", *(F.when(~F.col("ghost"), F.col(c)).alias(c) for c in ("nx", "ns", "b")))
        columns, sums = self.COLUMNS, self.SUMS

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[~pdf["ghost"]]
            along = lambda a, b: b if base == "x" else a + beta * (a - b)
            x, s = chunked.slices_of(pdf, "x"), chunked.slices_of(pdf, "s")
            y = {k: along(s[k], x[k]) for k in s}
            nx, ns, b = (chunked.slices_of(own, c) for c in ("nx", "ns", "b"))
            out = []
            for k in nx:
                ny = along(ns[k], nx[k])
                g = ny - b[k] + chunked.prior_slice(*chunked.beside(y, k), sigma, p) + more
                c, nc = y[k] - step * g, ny - step * normal(g)
                kept, nkept = (x[k], nx[k]) if keep == "x" else (s[k], ns[k])
                totals = [(c * (nc - 2 * b[k])).sum(1), (y[k] * (ny - 2 * b[k])).sum(1), (g * g).sum(1), ((c - x[k]) ** 2).sum(1), (c * c).sum(1)]
                rows = {"slice_id": np.int32(k), "row_id": np.arange(len(c), dtype=np.int32)}
                rows |= {name: list(v) for name, v in zip(columns, (kept, nkept, c, nc, b[k]), strict=True)}
                out.append(pd.DataFrame(rows | dict(zip(sums, totals, strict=True))))
            return pd.concat(out)

        after = self._saved(light.groupBy("chunk_id").applyInPandas(run, self.SCHEMA))
        fx, fy, gg, dd, ss = (v or 0.0 for v in after[0].agg(*(F.sum(c) for c in self.SUMS)).first())
        if hasattr(self.save, "drop"):
            self.save.drop(name)
        root = lambda square: float(np.sqrt(max(0.0, self.norm + square)))
        return after, optimize.Sums(root(fx), root(fy), gg, dd, ss)

    def settle(self, state: tuple) -> tuple:
        df, name = state
        return df.withColumns({"x": F.col("s"), "nx": F.col("ns")}), name

    def images(self, state: tuple) -> DataFrame:
        return state[0].select("slice_id", "row_id", F.col("s").alias("values"))


def solve(
    start: DataFrame, sino: DataFrame, theta, save: Save, iterations: int = 100, sigma: float = 100.0, p: float = 1.2,
    tol: float = 1e-4, xtol: float = 1e-4, method: str = "toeplitz", early_stop: bool = False, curvature: bool = False,
) -> Solved:
    """Backtracking descent on the misfit and the edge-preserving prior, with momentum on retried steps (``optimize.backtracking``).

    ``save`` writes a frame to the shared folder and rereads it; its ``drop``, if it has one, removes iterates that no later
    step reads. With ``method`` toeplitz the point spread is summed on executors, written, and read by the tasks.
    """
    if method not in ("toeplitz", "direct"):
        raise ValueError("method is toeplitz or direct")
    theta, spark = np.asarray(theta, float), start.sparkSession
    n = _width(start)
    back = save(T.backproject(sino, theta), "back")
    norm = sino.agg(A.squares(sino)).first()[0] or 0.0
    spread = None
    if method == "toeplitz":
        angles = spark.createDataFrame([(k, float(t)) for k, t in enumerate(theta)], "proj_id long, theta double")
        spread = toeplitz.Stored(save(toeplitz.spread_rows(angles, n), "spread"))
    normal = normal_of(theta, n, spread)
    problem = Fused(back, norm, normal, sigma, p, save, curvature)
    out = optimize.backtracking(problem, start, iterations, lipschitz_step(spark, n, normal), tol, xtol, early_stop)
    if iterations and hasattr(save, "drop"):
        save.drop("back")
    return Solved(out.images, out.errors, out.ended)


def mbir(
    sino: DataFrame, theta, center: float, save: Save, iterations: int = 100, smoothness: float = 0.01, start: DataFrame | None = None,
    tol: float = 1e-4, xtol: float = 1e-4, method: str = "toeplitz", early_stop: bool = False, scale: str = "max",
) -> Solved:
    """Model-based reconstruction: the sinogram is scaled, centred, padded, solved and cropped.

    ``scale`` "max" divides the sinogram by its maximum; "minmax" takes its range to 0..1.

    ``smoothness`` is 1 / sigma of the prior. Without ``start`` the solver begins at the filtered back-projection of the
    sinogram as it came, neither centred nor padded; either is padded with zeros to the solver's width. A
    sinogram whose maximum is 0 returns ``start``, or zeros.
    """
    if smoothness <= 0:
        raise ValueError("smoothness must be above 0")
    theta = np.asarray(theta, float)
    odd = A.odd_columns(sino)
    n = _width(odd)
    top = odd.agg(F.max(F.array_max("values"))).first()[0] or 0.0
    if top <= 0:
        blank = start if start is not None else A.each(T.backproject(odd, theta), lambda v: v * 0.0)
        return Solved(blank, [], "empty")
    if scale not in ("max", "minmax"):
        raise ValueError("scale is max or minmax")
    scaled = save(A.each(odd, lambda v: v / F.lit(float(top))) if scale == "max" else A.normalize(odd), "scaled")
    padded = save(A.recentre(scaled, n, center), "padded")
    first = T.backproject(scaled, theta, True) if start is None else start
    first = A.pad_image(first, _width(padded) - n, n)
    out = solve(first, padded, theta, save, iterations, 1 / smoothness, 1.2, tol, xtol, method, early_stop)
    return Solved(crop(out.images, n), out.errors, out.ended)
