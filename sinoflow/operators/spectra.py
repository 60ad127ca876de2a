"""Complex arrays and Fourier transforms on rows (slice_id, row_id, re array<double>, im array<double>).

Transforms over rows run on Arrow batches, those over whole slices on a slice a group; inverses are not normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPLEX = "slice_id long, row_id long, re array<double>, im array<double>"


def to_complex(df: DataFrame) -> DataFrame:
    """Real rows with imaginary parts of 0."""
    return df.select(F.col("slice_id").cast("long").alias("slice_id"), F.col("row_id").cast("long").alias("row_id"), F.col("values").alias("re"), F.transform("values", lambda v: F.lit(0.0)).alias("im"))


def real_part(df: DataFrame) -> DataFrame:
    return df.select("slice_id", "row_id", F.col("re").alias("values"))


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("slice_id", "row_id", F.col("re").alias("_re"), F.col("im").alias("_im")), ["slice_id", "row_id"])


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Complex sums element by element, joined by place."""
    return _met(a, b).select("slice_id", "row_id", *(F.zip_with(c, f"_{c}", lambda p, q: p + q).alias(c) for c in ("re", "im")))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _met(a, b).select("slice_id", "row_id", *(F.zip_with(c, f"_{c}", lambda p, q: p - q).alias(c) for c in ("re", "im")))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Complex quotients element by element, joined by place; null where the divisor is 0."""
    size = F.zip_with("_re", "_im", lambda p, q: p * p + q * q)
    top = multiply(a, b.withColumn("im", F.transform("im", lambda v: -v)))
    over = _met(top, b)
    return over.select("slice_id", "row_id", *(F.zip_with(c, size, lambda p, q: F.try_divide(p, q)).alias(c) for c in ("re", "im")))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Complex products element by element, joined by place."""
    met = _met(a, b)
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    return met.select("slice_id", "row_id", F.zip_with(both("re", "_re"), both("im", "_im"), lambda p, q: p - q).alias("re"), F.zip_with(both("re", "_im"), both("im", "_re"), lambda p, q: p + q).alias("im"))


def _rows(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` on the matrix of each run of rows of one length; it works along the last axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            re, im = ([np.asarray(x.values) for x in b.column(k)] for k in (2, 3))
            size = np.array([len(x) for x in re])
            for cut in np.split(np.arange(len(re)), np.flatnonzero(np.diff(size)) + 1):
                if not len(cut):
                    continue
                own = slice(int(cut[0]), int(cut[-1]) + 1)
                out = kernel(np.stack(re[own]) + 1j * np.stack(im[own])) if size[cut[0]] else np.zeros((len(cut), 0), complex)
                yield pa.RecordBatch.from_arrays([b.column(0)[own], b.column(1)[own], pa.array(list(out.real)), pa.array(list(out.imag))], ["slice_id", "row_id", "re", "im"])

    return df.select("slice_id", "row_id", "re", "im").mapInArrow(run, COMPLEX)


def fft1d(df: DataFrame) -> DataFrame:
    return _rows(df, lambda x: np.fft.fft(x, axis=-1))


def ifft1d(df: DataFrame) -> DataFrame:
    return _rows(df, lambda x: np.fft.ifft(x, axis=-1) * x.shape[-1])


def _slices(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        out = kernel(np.stack(pdf["re"].to_list()) + 1j * np.stack(pdf["im"].to_list()))
        return pd.DataFrame({"slice_id": int(pdf["slice_id"].iloc[0]), "row_id": np.arange(len(out)), "re": list(out.real), "im": list(out.imag)})

    return df.groupBy("slice_id").applyInPandas(run, COMPLEX)


def fft2d(df: DataFrame) -> DataFrame:
    return _slices(df, np.fft.fft2)


def ifft2d(df: DataFrame) -> DataFrame:
    return _slices(df, lambda x: np.fft.ifft2(x) * x.size)


def rfft2d(df: DataFrame) -> DataFrame:
    """Of the real parts; n // 2 + 1 columns."""
    return _slices(df, lambda x: np.fft.rfft2(x.real))


def irfft2d(df: DataFrame, columns: int) -> DataFrame:
    """To real slices of ``columns`` columns."""
    return _slices(df, lambda x: np.fft.irfft2(x, s=(x.shape[0], columns)) * (x.shape[0] * columns))
