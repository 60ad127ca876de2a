"""Where sinograms and volumes come from and go to: Parquet row-blocks and NumPy arrays (``container`` has array containers and raw files).

A row-block is (slice_id, row_id, values array<double>). On disk the rows of a stack lie in files that are ranges of
slices, in order, so a range of slices is pruned by the files' own statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slice_id int, row_id int, values array<double>"


def read_stack(spark: SparkSession, path: str, begin: int = 0, end: int = -1, projections_first: bool = False) -> DataFrame:
    """Row-blocks at ``path``, slices [begin, end) (-1: to the last one); the range reaches the scan.

    With ``projections_first`` the stored axes are (projection, slice, column) and are swapped.
    """
    df = spark.read.schema(SCHEMA).parquet(path)
    if projections_first:
        df = df.select(F.col("row_id").alias("slice_id"), F.col("slice_id").alias("row_id"), "values")
    if begin < 0 or (end != -1 and end <= begin):
        raise ValueError("slices must be [begin, end) with 0 <= begin < end")
    if begin:
        df = df.where(F.col("slice_id") >= begin)
    return df if end == -1 else df.where(F.col("slice_id") < end)


def write_stack(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Row-blocks as Parquet, a range of slices a file."""
    rows = df.select(F.col("slice_id").cast("int"), F.col("row_id").cast("int"), F.col("values").cast("array<double>"))
    rows.repartitionByRange("slice_id").sortWithinPartitions("slice_id", "row_id").write.mode(mode).parquet(path)


def read_angles(spark: SparkSession, path: str) -> np.ndarray:
    """The angles in radians, in order of proj_id, as one array; a stack has a few thousand at most."""
    rows = spark.read.schema("proj_id int, theta double").parquet(path).orderBy("proj_id").collect()
    return np.array([r["theta"] for r in rows], float)


def write_angles(spark: SparkSession, theta, path: str, mode: str = "errorifexists") -> None:
    flat = np.asarray(theta, float).ravel()
    frame = spark.createDataFrame([(k, float(t)) for k, t in enumerate(flat)], "proj_id int, theta double")
    frame.coalesce(1).write.mode(mode).parquet(path)


def from_numpy(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """A two- or three-dimensional array as row-blocks; two dimensions are one slice."""
    a = np.asarray(array, float)
    if a.ndim == 2:
        a = a[None]
    if a.ndim != 3:
        raise ValueError("the array must have two or three dimensions")
    s, r, _ = a.shape
    slices, rows = np.repeat(np.arange(s, dtype=np.int32), r), np.tile(np.arange(r, dtype=np.int32), s)
    values = pa.array(list(a.reshape(s * r, -1)), pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"slice_id": slices, "row_id": rows, "values": values}))


def to_numpy(df: DataFrame) -> np.ndarray:
    """All rows as one array [slice, row, column], on the driver: for results that are meant to be there."""
    pdf = df.select("slice_id", "row_id", "values").toPandas().sort_values(["slice_id", "row_id"])
    if pdf.empty:
        return np.zeros((0, 0, 0))
    counts = pdf["slice_id"].value_counts()
    if counts.nunique() != 1:
        raise ValueError("the slices differ in their number of rows")
    return np.stack(pdf["values"].to_list()).reshape(len(counts), int(counts.iloc[0]), -1)
