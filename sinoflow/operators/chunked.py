"""The edge-preserving prior by chunks of slices: each chunk comes with its border slices, and a NumPy kernel does the rest.

A row is sent once, and once more where its slice borders on another chunk; ``arrays.prior_gradient`` sends each row twice
through windows. Within a task a chunk is worked on slice by slice, so temporaries hold three slices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import arrays
from .transforms import ROWS


def prior_slice(below: np.ndarray, own: np.ndarray, above: np.ndarray, sigma: float, p: float = 1.2, c: float = 0.001) -> np.ndarray:
    """The prior's gradient on one slice between its neighbours; rows and columns repeat at their ends."""
    planes = [np.pad(s, 1, mode="edge") for s in (below, own, above)]
    rows, cols = own.shape
    out = np.zeros(own.shape)
    for k, j, i, weight in arrays.weights():
        d = own - planes[1 + k][1 + j : 1 + j + rows, 1 + i : 1 + i + cols]
        t = np.power(np.abs(d) / sigma, 2 - p)
        out += weight * (d / ((t + c) * sigma**2) * (2.0 - (2 - p) * t / (t + c)))
    return out


def slices_of(pdf: pd.DataFrame, column: str) -> dict[int, np.ndarray]:
    """A matrix a slice; ``pdf`` has whole slices."""
    pdf = pdf.sort_values(["slice_id", "row_id"])
    ids = pdf["slice_id"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
    values = pdf[column].to_list()
    return {int(ids[a]): np.stack(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}


def beside(stack: dict[int, np.ndarray], s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice between its neighbours; the first and the last are their own."""
    return stack.get(s - 1, stack[s]), stack[s], stack.get(s + 1, stack[s])


def prior_chunks(df: DataFrame, sigma: float, p: float = 1.2, c: float = 0.001, parts: int | None = None, slices: int | None = None) -> DataFrame:
    """As ``arrays.prior_gradient``, by ``parts`` chunks of slices (as many as the session has shuffle partitions). All slices from 0 on are there."""
    slices = slices or int(arrays.dims(df).first()["slices"] or 0)
    if not slices:
        return df.select("slice_id", "row_id", "values")
    parts = min(slices, parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stack, own = slices_of(pdf, "values"), sorted(set(pdf.loc[~pdf["ghost"], "slice_id"]))
        out = [prior_slice(*beside(stack, s), sigma, p, c) for s in own]
        n = [len(m) for m in out]
        return pd.DataFrame({"slice_id": np.repeat(own, n), "row_id": np.concatenate([np.arange(k) for k in n]), "values": [r for m in out for r in m]})

    met = arrays.chunks(df.select("slice_id", "row_id", "values"), slices, parts, 1)
    return met.groupBy("chunk_id").applyInPandas(run, ROWS)
