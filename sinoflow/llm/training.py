"""What the trained classifiers share: a bounded sample of labelled documents, and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_bytes, text_of

#: Labelled rows that a model is fitted on at most: the documented bound of the sample, taken in order of a hash of doc_id.
SAMPLE = 6000
#: Bytes of texts that a worker is sent at a time, a single row apart.
BATCH_BYTES = 2 << 20


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int = SAMPLE) -> DataFrame:
    """(text, label double) of ``sample`` labelled documents at most among those that ``keep`` allows.

    Of labels that contradict each other the greatest counts; null labels and null ids are ignored.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("text"))
    return texts.join(F.broadcast(known), texts["_doc"] == known["_id"]).select(F.xxhash64("_id").alias("at"), "text", "label")  # SAMPLE rows bound the broadcast


def fitted_rows(sample: DataFrame, features: Callable[[str], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The features (any shape, float32) and labels of the sample, in a fixed order. Features are made on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.ascontiguousarray(features(t), "<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], ["at", "x", "label"])

    with arrow_bytes(sample.sparkSession, BATCH_BYTES):
        rows = sorted((r[0], bytes(r[1]), r[2]) for r in sample.mapInArrow(run, "at long, x binary, label double").collect())
    return [np.frombuffer(x, "<f4").astype(np.float64) for _, x, _ in rows], np.array([y for _, _, y in rows])


def score_texts(docs: DataFrame, score: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row, in Arrow batches. The scores are written, so that the bound of batches holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score([t or "" for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        return Scratch(docs.sparkSession, "scores").save(rows.mapInArrow(run, "doc_id long, score double"), "scores")
