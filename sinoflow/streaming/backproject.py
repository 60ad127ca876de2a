"""Back-projection of sinograms whose rows stream in: a slice is reconstructed as soon as all of its rows have come.

The rows of a slice wait in keyed state on disk (RocksDB, checkpointed in the shared folder); files may hold any rows in any
order. Of rows with one place the first to come counts; of those that come at once it is the least by its values, compared
one after the other. Rows of a slice that has been given out, late or repeated, are ignored, and so are rows whose place
is not in [0, rows). A slice that never gets all its rows gives nothing; its rows stay in the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import transforms as T
from ..sources.volumes import SCHEMA

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Gather(StatefulProcessor):
    """Holds a slice's rows until there are ``rows`` of them and gives ``kernel`` of their matrix."""

    def __init__(self, rows: int, kernel: Callable[[np.ndarray], np.ndarray]) -> None:
        self.rows, self.kernel = rows, kernel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "row_id int", "values array<double>")
        self.count = handle.getValueState("count", "n int")  # of rows held; -1: given out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        came: dict[int, list[float]] = {}
        for pdf in rows:
            for r, v in zip(pdf["row_id"], pdf["values"], strict=True):
                if 0 <= r < self.rows and (r not in came or list(v) < came[r]):
                    came[int(r)] = list(v)
        if n < 0:
            return
        for r in sorted(came):
            if not self.held.containsKey((r,)):
                self.held.updateValue((r,), (came[r],))
                n += 1
        self.count.update((n if n < self.rows else -1,))
        if n == self.rows:
            out = self.kernel(np.stack([np.asarray(self.held.getValue((r,))[0], float) for r in range(self.rows)]))
            self.held.clear()
            yield pd.DataFrame({"slice_id": np.int32(key[0]), "row_id": np.arange(len(out), dtype=np.int32), "values": list(out)})

    def close(self) -> None:
        pass


def backproject(rows: DataFrame, theta, center: float, columns: int, filtered: bool = True) -> DataFrame:
    """Streaming rows of sinograms of ``columns`` columns to the images that ``fbp`` (or ``adjoint``) makes of them, in append mode."""
    from ..plans.reconstruct import crop_slice, prepare_slice

    theta = np.asarray(theta, float)
    kernel = lambda y: crop_slice(T.backproject_slice(prepare_slice(y, center), theta, filtered), (columns - 1) | 1)
    whole = rows.select(F.col("slice_id").cast("int").alias("slice_id"), F.col("row_id").cast("int").alias("row_id"), F.col("values").cast("array<double>").alias("values"))
    whole = whole.where("slice_id is not null and row_id is not null and values is not null")
    return whole.groupBy("slice_id").transformWithStateInPandas(Gather(len(theta), kernel), SCHEMA, "Append", "None")


def run(spark: SparkSession, path: str, out: str, checkpoint: str, theta, center: float, columns: int, filtered: bool = True, files: int = 100) -> None:
    """All row-block files at ``path`` that a run with this ``checkpoint`` has not seen, ``files`` a batch; images are appended to ``out``."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
        images = backproject(rows, theta, center, columns, filtered)
        query = images.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
