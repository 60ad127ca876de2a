"""Registered queries against their SQL or plain versions on the smallest tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from sinoflow.llm import queries, simhash


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text, source FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, small)
    want = con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(map(tuple, got.collect())) == sorted(want[got.columns].itertuples(index=False, name=None))


def test_simhash_as_all_pairs(spark, small, docs):
    fps = [simhash.fingerprint(t.encode()) for _, t, _ in docs]
    least = [d for d, _, _ in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, small).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, _, _), f, c in zip(docs, fps, least, strict=True)}


def test_tokens_as_the_library(spark, small, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want, start = {}, 0
    for d, text, _ in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op8_tokens(spark, small).collect()} == want


def test_mix_meets_targets(spark, small, docs):
    rows = queries.op9_mix(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _, _ in docs]
    assert sorted(rows) == sorted(queries.op9_mix(spark, small).collect())
    of = {d: s for d, _, s in docs}
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(of[r["doc_id"]], []).append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v)


def test_mix_lands_near_targets(spark):
    """Each source's words are within 1 % of its target, or within its smallest document."""
    sf_dir = "/root/testdata/sf0.01"
    of = dict(duckdb.sql(f"SELECT doc_id, source FROM '{sf_dir}/documents.parquet'").fetchall())
    by = {}
    for r in queries.op9_mix(spark, sf_dir).collect():
        by.setdefault(of[r["doc_id"]], []).append(r)
    for s, v in by.items():
        off = abs(sum(r["taken"] for r in v) - v[0]["target"])
        assert off <= max(0.01 * v[0]["target"], min(r["size"] for r in v if r["size"])), (s, off, v[0]["target"])


def test_pipeline_keeps_document_columns(spark, small):
    docs = queries.table(spark, small, "documents")
    one = corpus_pipeline.near_dedup(spark, docs, small)
    kept = corpus_pipeline.decontaminated(spark, one, small)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in queries.op2_decontaminate(spark, small).collect() if r["contaminated"]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in one.collect() if r["doc_id"] not in bad)


def shingles(text, words=5):
    w = text.encode().lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def test_near_dedup_as_all_pairs(spark):
    """Against Jaccard similarity by brute force: clear copies go, the rest stays, and so do texts that are alike in words only."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8)))
    base, texts = [[word() for _ in range(r.randint(60, 400))] for _ in range(30)], []
    for b in base:
        texts.append(" ".join(b))
        for edits in (0, 1, 2, len(b) // 8, len(b) // 3):
            c = list(b)
            for k in r.sample(range(len(c)), edits):
                c[k] = word()
            texts.append(" ".join(c))
        texts.append(" ".join(r.sample(b, len(b))))
    hot = [word() for _ in range(150)]
    texts += [" ".join([*hot[:k], word(), *hot[k:]]) for k in range(150)]  # one group of near copies
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    alike = [(a, b, s) for b in range(len(texts)) for a in range(b) if (s := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.7]

    def dropped(least):
        root = list(range(len(texts)))
        for a, b, s in alike:
            if s >= least:
                x, y = root[a], root[b]
                root = [min(x, y) if v in (x, y) else v for v in root]
        return {k for k, v in enumerate(root) if k != v}

    for crowd in (20, 64):
        gone = set(range(len(texts))) - {x["doc_id"] for x in simhash.one_of_each(df, crowd=crowd).collect()}
        assert gone <= dropped(0.7)
        for least, share in ((0.95, 0.98), (0.9, 0.9)):
            assert len(dropped(least) & gone) >= share * len(dropped(least))
