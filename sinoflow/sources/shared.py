"""Tables of one job in the folder that the cluster's machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shared:
    """Parquet tables under ``spark.checkpoint.dir``: they cut lineage and survive lost executors.

    Called with a frame and a name it writes the frame and reads it again; ``drop`` removes a table as soon as nothing reads
    it, and all goes when the driver's process ends. Where the setting is missing, on one machine, a temporary folder is
    taken; a cluster needs the setting.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="sinoflow-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/sinoflow-{what}-{uuid.uuid4().hex}"
        atexit.register(self.drop, "")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        sc = self.spark.sparkContext
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the shared folder's own cleaning takes the rest
            pass
