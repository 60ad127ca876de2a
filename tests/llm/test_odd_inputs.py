"""Nulls, empty and long texts, repeated rows and ids, empty tables and clashing column names, for each operator and stage."""

import hashlib
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sinoflow.llm import common, decontaminate, exact_dedup, mixing, queries, simhash, token_output

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(random.Random(3).choices([f"w{k}" for k in range(5000)], k=30_000))
A, B = "the quick brown fox jumps over the lazy dog again and again", "pack my box with five dozen liquor jugs before the night falls"
ROWS = [(1, A, "en", "s", 1), (1, A, "en", "s", 1), (1, B, "en", "t", 1), (None, A, "en", None, 1), (None, A, "en", None, 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "  ", "en", "s", 2), (4, LONG, "en", "t", 1), (5, LONG + " x", "en", "t", 1)]
CLASH = ("_metadata", "row", "digest", "at", "n", "copies", "_id", "_k", "_row", "_keep", "_of", "component_id", "fp", "spans", "items", "block", "source_size")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH)).coalesce(2)


def key(r):
    return tuple((x is not None, x) for x in r)


def test_exact_dedup(spark, odd, tmp_path):
    path = str(tmp_path / "documents.parquet")
    odd.repartition(4, "doc_id").write.parquet(path)
    texts = Counter(t or "" for _, t, *_ in ROWS)
    best = {t: max((d for d, x, *_ in ROWS if (x or "") == t), key=lambda d: (d is not None, d)) for t in texts}
    want = sorted(((d, best[t or ""], texts[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in ROWS), key=key)
    one_digit = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)  # noqa: E731  digests that clash
    for at, more in ((path, {}), (path + "/", {"batch_bytes": 1}), (path, {"digest": one_digit})):
        rows = exact_dedup.exact_dedup(spark, at, **more).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=key) == want
        assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    odd.limit(0).write.parquet(str(tmp_path / "none.parquet"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none.parquet")).count() == 0


def plain_leaks(text, items):
    words = lambda t: decontaminate.words_of((t or "").encode())
    w, hit, found = words(text), set(), set()
    for item, t in items:
        for win in decontaminate.windows_of(words(t)):
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= set() if item is None else {str(item)}
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark, odd):
    items = [(7, A), (7, A), (8, "lazy dog"), (None, "five dozen"), (9, None), (10, ""), (11, " ".join(LONG.split()[100:140])), (12, "THE lazy-dog")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *plain_leaks(t, items)) for d, t, *_ in ROWS), key=lambda r: (key(r[:3]), r[3]))
    for block_bytes in (1 << 20, 40):  # one block and several
        rows = decontaminate.contamination(odd, bench, block_bytes=block_bytes).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in rows), key=lambda r: (key(r[:3]), r[3])) == want
        clean = decontaminate.clean_documents(odd, bench, block_bytes=block_bytes)
        assert clean.columns == odd.columns and clean.count() == sum(not n for _, _, n, _ in want)
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(odd, bench.limit(0)).collect()} == {0}


def test_simhash(spark, odd):
    fps = [simhash.fingerprint((t or "").encode()) for _, t, *_ in ROWS]
    for hot in (0, 1, 512):
        rows = simhash.near_duplicates(odd, hot=hot).collect()
        got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows)
        comp = list(range(len(fps)))
        for _ in fps:
            comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        least = {c: min((ROWS[i][0] for i in range(len(fps)) if comp[i] == c and ROWS[i][0] is not None), default=None) for c in comp}
        assert got == Counter((d, f, least[c]) for (d, *_), f, c in zip(ROWS, fps, comp, strict=True))
    for crowd in (1, 64):
        kept = simhash.one_of_each(odd, crowd=crowd)
        assert kept.columns == odd.columns and {r["row"] for r in kept.collect()} == {"own row"}
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, B), (1, A), (2, ""), (4, LONG)]
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_tokens(spark, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    rows = token_output.encode_corpus(odd, queries.tokenizer_path()).orderBy("start").collect()
    ids = lambda t: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = Counter((d, len(x := ids(t)), zlib.crc32(x.tobytes())) for d, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    who = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert who == sorted(who)
    assert token_output.encode_corpus(odd.limit(0), queries.tokenizer_path()).count() == 0
    path = common.Scratch(spark, "test").path("tokens")
    token_output.write_tokens(odd, queries.tokenizer_path(), path, block_ids=50)
    got = token_output.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((d, tuple(ids(t).tolist())) for d, t, *_ in ROWS)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_packing(bits):
    r = np.random.default_rng(bits)
    ids = r.integers(0, 2**bits, 1000).astype(np.uint32)
    data = token_output.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (0, 0), (1000, 1000), (1, 2), (333, 777)):
        assert np.array_equal(token_output.unpack(data, bits, a, b), ids[a:b])
    block = token_output.Block(token_output.write_block([5, None, 7], [400, 0, 600], ids, bits))
    assert np.array_equal(block.ids(2), ids[400:]) and len(block.ids(1)) == 0 and np.array_equal(block.all(), ids)


def test_encoder_as_the_library(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    definition = open(queries.tokenizer_path(), encoding="utf-8").read()
    lib, r = Tokenizer.from_str(definition), random.Random(1)
    signs = [*"abcXYZ  \n\t\r'''.,!?019éßÜœ–’“中文😀½²ʼЖжαà_-\v", "  ", "\n\n", "'s", "'re", " 'll", "́", "١"]
    rare = ["<|endoftext|>", " ", " ", "\x1c", "\x85"]
    texts = ["".join(r.choices(signs + rare * (k % 3 == 0), k=r.randint(0, 40))) for k in range(20_000)] + [None, "", " ", "\n"]
    want = [e.ids for e in lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for chunk, most in ((1 << 20, 10_000), (1 << 8, 100)):
        monkeypatch.setattr(token_output.ByteLevel, "CHUNK", chunk)
        encode = token_output.tokenizer_of(definition, most)[0]
        assert [x.tolist() for x in encode(pa.array(texts))] == want
    long = " ".join(["word another"] * 200)
    assert encode(pa.array([long]))[0].tolist() == lib.encode(long, add_special_tokens=False).ids


def test_mix_keeps_both_balances(spark, odd):
    r = random.Random(0)
    docs = [(k if k % 7 else None, "w " * r.choice([0, 1, 5, 5, 40]), r.choice(["a", "a", "a", "b", None])) for k in range(400)] + [(9, "w w w", "a")] * 200
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(2)
    for block in (8, 4096):
        rows = mixing.mix(df, block=block).collect()
        assert sorted((r["row"] for r in rows)) == sorted(set(r["row"] for r in rows)) and len(rows) == len(docs)
        size = Counter()
        for _, t, s in docs:
            size[s] += len(t.split())
        names = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
        while open_:  # reshare the excess until none is above
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            above = {s for s in open_ if share[s] > 2 * size[s]}
            target |= {s: 2.0 * size[s] for s in above} if above else share
            open_, left = (open_ - above, left - sum(2.0 * size[s] for s in above)) if above else (set(), 0)
        for s in names:
            own = [r for r in rows if r["source"] == s]
            rate = target[s] / size[s]
            assert all(abs(r["target"] - target[s]) < 1e-6 and r["taken"] == r["copies"] * r["size"] and r["copies"] in (int(rate), int(rate) + (rate % 1 > 0)) for r in own)
            assert abs(sum(r["taken"] for r in own) - target[s]) <= 40  # the longest document
            assert abs(sum(r["copies"] for r in own) - rate * len(own)) <= 2
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(df, block=block).collect()) == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)
    taken = mixing.take_copies(odd)
    assert taken.columns == odd.columns and {(r["row"], r["_row"], r["copies"]) for r in taken.collect()} == {("own row", "own _row", "own copies")}
    assert mixing.take_copies(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_stages_on_odd_documents(spark, odd, small):
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns
        out.count()
        assert stage(spark, odd.limit(0), small).count() == 0


def test_workers_need_no_package(spark, small, tmp_path):
    """What goes to the workers can be read where the package is not installed."""
    from pyspark import cloudpickle

    from sinoflow.llm import quality, toxicity

    x, y = np.random.default_rng(0).normal(size=(40, toxicity.N_FEATURES)), np.arange(40) % 2
    model = toxicity.Toxicity(x, y.astype(float))
    bags = quality.Attention([r.normal(size=(2, quality.N_FEATURES)) for r in [np.random.default_rng(k) for k in range(8)]], np.arange(8) % 2.0)
    definition = open(queries.tokenizer_path(), encoding="utf-8").read()
    jobs = [lambda: model.score(["some text"]), lambda: bags.score(["some text"]), lambda: common.kept("k", lambda: token_output.tokenizer_of(definition))[1], lambda: simhash.fingerprint(b"a b c")]
    at = tmp_path / "jobs"
    at.write_bytes(cloudpickle.dumps(jobs))
    run = "import pickle, sys; jobs = pickle.load(open(sys.argv[1], 'rb')); [j() for j in jobs]; assert not any(m.startswith('sinoflow') for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", run, str(at)], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr


def test_landing_tries_all_cases():
    from itertools import product

    r = random.Random(5)
    for _ in range(60):
        n = r.randint(0, 9)
        pi, size = [r.choice([0.0, 1.0, r.random(), r.random()]) for _ in range(n)], [float(r.choice([1, 2, 5, 9, 40, 333])) for _ in range(n)]
        open_ = [k for k in range(n) if 0 < pi[k] < 1]
        words, docs = sum(pi[k] * size[k] for k in open_), sum(pi[k] for k in open_)
        got = mixing.landing(pi, size)
        assert all(g in (0.0, 1.0) and (k in open_ or g == pi[k]) for k, g in enumerate(got))
        assert abs(sum(got[k] for k in open_) - docs) < 1 + 1e-6
        least = min(abs(sum(c * size[k] for c, k in zip(case, open_, strict=True)) - words) for case in product((0, 1), repeat=len(open_)) if abs(sum(case) - docs) < 1)
        assert abs(abs(sum(got[k] * size[k] for k in open_) - words) - least) < 1e-5


def test_only_texts_met_again_are_dealt_out(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.sha2(F.concat(F.col("id") % 2900).cast("binary"), 256).alias("digest"), F.concat(F.lit("t"), F.col("id") % 2900).alias("text"))
    state = docs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    got = sorted(r["text"] for r in exact_dedup.met_again(docs, state).collect())
    assert got == sorted(f"t{k}" for k in range(100) for _ in range(2))
    some = [r["text"] for r in exact_dedup.met_again(docs, state, bits=4).collect()]  # a full bitmap lets more pass, and all that must
    assert len(some) > len(got) and not set(got) - set(some)
    assert exact_dedup.met_again(docs, state.where("n > 5")).count() == 0
