"""Exact deduplication with streaming keyed state on disk.

Documents stream in. The state, kept by RocksDB and checkpointed in the shared folder, has a row for each SHA-256
digest ever seen and never expires: the stable identifier (largest doc_id so far), the content locator (file and row
index) of that document, and how many rows had the digest. Spark's partial aggregation meets copies before they are
dealt out, so a text that makes up a third of all rows reaches its state as one row a task.

The texts of digests that the state has met more than once are then compared byte for byte: a digest with more than one
distinct text is a clash, and its rows are grouped by their texts instead. Texts of other digests stay where they are: a
bitmap of the digests met again, of ``2 ** BITS`` bits whatever the corpus, is sent to the tasks and lets only these pass,
with a few that share a bit. Each task deals out one copy of each text it has.

Null text counts as empty. Of equal texts the largest doc_id stays; among repeated rows of that id the last in
(file, row) order stays, so one row of each group does. A null doc_id is below all others. An empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, text_of

#: Bytes of input files that one micro-batch takes.
BATCH_BYTES = 8 << 30
#: Bits of the bitmap of digests met again (16 MB): where it fills up more texts are compared, none less.
BITS = 27
RESULT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, path: str, scratch: Scratch, digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Runs the documents at ``path`` through the keyed state; returns the state: digest, keeper (doc_id, file, row), n.

    Lost executors read the state again from the checkpoint; the checkpoint goes with the run.
    """
    path = path.rstrip("/")
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # each partition's log would hold 4 MB more than it fills
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may also match one file
        seen = located(docs, digest).groupBy("digest").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
        query = (
            seen.writeStream.outputMode("update")
            .option("checkpointLocation", scratch.path("state"))
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(scratch.path(f"updates/batch={k}")))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, keeper struct<doc_id: bigint, file: string, row: bigint>, n bigint, batch int"
    if not query.recentProgress or not any(p.numInputRows for p in query.recentProgress):
        return spark.createDataFrame([], schema).drop("batch")
    updates = spark.read.schema(schema).parquet(scratch.path("updates"))
    # Of a digest's updates the last holds the state; n only grows.
    return updates.groupBy("digest").agg(F.max(F.struct("n", "keeper")).alias("s")).select("digest", "s.keeper", "s.n")


def located(docs: DataFrame, digest=sha256) -> DataFrame:
    """(digest, at): at is the row's identifier and locator."""
    place = docs.metadataColumn("_metadata")  # the file source's, whatever columns there are
    at = F.struct(F.col("doc_id").cast("long").alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"))
    return docs.select(digest(text_of()).alias("digest"), at.alias("at"), text_of().alias("text"))


def met_again(docs: DataFrame, state: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` whose digest the state has met more than once, and a few others."""
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << bits)) + 1
    again = state.where("n > 1").select(at.alias("b"))
    table = again.groupBy(F.bitmap_bucket_number("b").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("_bits"))
    place = F.bitmap_bit_position(at)
    met = docs.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_place", place).join(F.broadcast(table), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("int(_place div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, F.col("_place") % 8) == 1).select(docs.columns)


def exact_dedup(spark: SparkSession, path: str, digest=sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row of the Parquet documents at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps a text column to the state's key. A weak one costs time, never the result.
    """
    scratch = Scratch(spark, "exact")
    state = scratch.save(stream_state(spark, path, scratch, digest, batch_bytes), "keys")
    docs = located(spark.read.parquet(path), digest)
    texts = met_again(docs.select("digest", "text"), state).distinct()  # a task's copies go on as one
    clash = scratch.save(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "clashes")
    rows = docs.select("digest", "at", sha256(F.col("text")).alias("text_sha256"))
    if clash.isEmpty():
        same = rows.join(state, "digest")
        return same.select(F.col("at.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("at").eqNullSafe(F.col("keeper")).alias("kept"), "text_sha256")
    torn = scratch.save(docs.join(clash, "digest", "left_semi"), "torn")
    groups = torn.groupBy("digest", "text").agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
    apart = torn.join(groups, ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text")))
    same = rows.join(clash, "digest", "left_anti").join(state, "digest")
    both = same.select("at", "keeper", "n", "text_sha256").unionByName(apart.select("at", "keeper", "n", "text_sha256"))
    return both.select(F.col("at.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("at").eqNullSafe(F.col("keeper")).alias("kept"), "text_sha256").repartition(partitions(spark))
