"""What a Python worker holds of texts is bounded by bytes, not by rows or by the length of a text."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sinoflow.llm import common, quality, queries, simhash, token_output
from sinoflow.llm.training import fitted_rows, score_texts


def test_texts_to_score_come_in_small_batches(spark):
    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))  # 40 MB in one task
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = score_texts(docs, lambda texts: np.full(len(texts), float(sum(map(len, texts))))).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert max(r["score"] for r in got) <= 4 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_texts_to_learn_from_come_whole(spark):
    sample = spark.range(50).select(F.col("id").alias("at"), F.repeat(F.lit("ab "), 100_000).alias("text"), F.lit(1.0).alias("label"))
    x, y = fitted_rows(sample, lambda t: np.array([len(t)]))
    assert len(y) == 50 and {float(v[0]) for v in x} == {300_000.0}


def plain_passages(text, size):
    words = [w for w in text.encode().replace(b"\n", b" \n").replace(b"\n ", b"\n").split(b" ") if w.strip()]
    return np.array([quality.encode(words[k : k + size]) for k in range(0, max(1, len(words)), size)], np.float64)


def test_pieces_change_no_passage(monkeypatch):
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(["a", "Bc", "\n", " ", "\t", "é", "."]) for _ in range(r.randint(0, 120)))
        monkeypatch.setattr(quality, "PIECE", r.choice([1, 2, 3, 5, 17, 40]), raising=False)
        size = r.choice([1, 2, 3, 60])
        assert np.array_equal(quality.passages(text, size), plain_passages(text, size))


def test_words_of_a_long_text_are_not_held_at_once():
    text = "some words " * 600_000
    tracemalloc.start()
    n = len(quality.passages(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 20_000 and peak < 6 * len(text)


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_executors_give_back_their_heap_before_each_stage(spark):
    before = full_collections(spark)
    stage = corpus_pipeline.staged(lambda spark, docs, sf_dir: full_collections(spark))
    assert stage(spark, spark.range(1), "") > before


def test_executors_give_back_their_heap_between_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(common, "give_back", asked.append, raising=False)
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("one two three four five six "), 20), F.col("id")).alias("text"))
    assert simhash.one_of_each(docs).count() == 1
    assert len(asked) >= 4


def test_pieces_that_workers_remember_change_no_token(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 200)).alias("text"))
    got = [sorted(map(tuple, token_output.encode_corpus(docs, queries.tokenizer_path(), pieces=n).collect())) for n in (20, token_output.KNOWN_PIECES)]
    assert got[0] == got[1] and len(got[0]) == 30
