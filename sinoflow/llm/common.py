"""What the operators share: the scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine, as in tests, one of our own.

    A cluster has no such folder of its own: there the setting is needed.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_sinoflow_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sinoflow-")
        spark._sinoflow_shared = at
        Scratch.delete(spark, at, later=True)
    return at


class Scratch:
    """Parquet tables of one run in the shared folder: they cut lineage and survive lost executors.

    ``save`` writes and rereads a frame, ``drop`` removes a table as soon as nothing reads it; what a returned frame
    still reads goes when the driver's process ends.
    """

    made: list[Scratch] = []  # of this process, for those who know when what they hold has been read

    def __init__(self, spark: SparkSession, what: str, heaps: bool = False) -> None:
        self.made.append(self)
        self.spark, self.heaps = spark, heaps
        self.root = f"{shared_dir(spark).rstrip('/')}/sinoflow-{what}-{uuid.uuid4().hex}"
        self.delete(spark, self.root, later=True)

    def __getstate__(self) -> dict:
        return {"root": self.root}  # workers have no session

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def save_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As save, dealt out by ``key``: joins by it need not deal the rows out again. ``df`` is read once."""
        n, table = partitions(self.spark), f"sinoflow_{uuid.uuid4().hex}"
        df.repartition(n, key).write.bucketBy(n, key).option("path", self.path(name)).saveAsTable(table)
        out = self.spark.table(table).select(df.columns)
        self.spark.sql(f"DROP TABLE {table}")  # the name alone: the files are ours, and ``out`` has found them
        return out

    def drop(self, name: str) -> None:
        """Removes the table; the files of finished shuffles go with their frames' garbage, and with ``heaps`` that of executors goes too."""
        self.delete(self.spark, self.path(name))
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        if self.heaps:
            give_back(self.spark)

    @staticmethod
    def delete(spark: SparkSession, path: str, later: bool = False) -> None:
        sc = spark.sparkContext

        def go() -> None:
            try:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001  the session has ended; the shared folder's own cleaning takes the rest
                pass

        atexit.register(go) if later else go()


def text_of(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def merged_with(df: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends no side to the driver, whatever the setting: of exploded or packed rows Spark's estimate is far too low."""
    return df.join(other.hint("merge"), on, how)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and return the heap that is free: else what one stage took is held, unused, beside the workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def arrow_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches that plans run in here send to Python workers end once they hold ``size`` bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(size, int(before.rstrip("b"))) if before.rstrip("b").isdigit() else size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(key, make):
    """What ``make`` gives, made once in a Python process and then kept for later tasks. It needs no module of ours."""
    import builtins

    known = builtins.__dict__.setdefault("_kept_by_key", {})
    if key not in known:
        known.clear()
        known[key] = make()
    return known[key]
