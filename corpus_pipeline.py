"""The corpus pipeline: documents to packed tokens in five stages, each on all that the one before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sinoflow.llm import decontaminate, mixing, quality, queries, simhash, token_output
from sinoflow.llm.common import Scratch, give_back
from sinoflow.llm.training import fold


#: Bytes of rows that a Python worker is sent at a time in any stage. It is set for the session: stages are plans that run later.
BATCH_BYTES = 2 << 20
#: Pieces of text that a worker remembers: it holds them beside the heap of a JVM that has run every stage.
KNOWN_PIECES = 100_000
#: Scratch tables of stages that have been called; a stage's rows are written before the next one is called.
_left: list[Scratch] = []


def staged(stage):
    """Bounds the workers' batches, and removes what earlier stages left in the shared folder, but for what ``docs`` still reads, and in the heaps."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        read = docs.inputFiles() if _left else []
        for old in [x for x in _left if not any(x.root.split(":")[-1].lstrip("/") in f for f in read)]:
            old.drop("")
            _left.remove(old)
        give_back(spark)
        before = len(Scratch.made)
        out = stage(spark, docs, sf_dir)
        _left.extend(Scratch.made[before:])
        return out

    return run


@staged
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, queries.table(spark, sf_dir, "labels"), fold(3) != 1)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the least doc_id stays, null last."""
    return simhash.one_of_each(docs)


@staged
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


@staged
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_copies(docs)


@staged
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.encode_corpus(docs, queries.tokenizer_path(), pieces=KNOWN_PIECES)


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("mix", mixed), ("tokens", tokens)]

#: SQL can express neither the trained classifier nor the sampling; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
    return docs
