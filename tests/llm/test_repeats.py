"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from sinoflow.llm import repeats

DOCS = "doc_id long, text string, s string"


def brute(texts, length):
    n = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, texts, length):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], DOCS)
    got = [tuple(r) for r in repeats.remove_repeats(docs, length).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == brute([(t or "").encode() for t in texts], length)


def test_repeats_as_brute_force(spark):
    for seed, length in ((0, 40), (1, 41), (2, 24), (3, 400)):
        r = random.Random(seed)
        word = lambda n, abc="abcdefgh é": "".join(r.choice(abc) for _ in range(n))  # noqa: E731, B023
        shared = [word(r.randint(length - 3, 3 * length)) for _ in range(6)]
        texts = [None, "", "x" * (length - 1), "y" * length, "z" * (length + 1), "ab" * length, word(2 * length, "ab")]
        for _ in range(40):
            parts = [word(r.randint(0, length))]
            for _ in range(r.randint(0, 4)):
                s = r.choice(shared)
                a = r.randint(0, len(s) // 3)
                parts += [s[a : r.randint(a, len(s))], word(r.randint(0, length // 2))]
            texts.append("".join(parts))
        texts += texts[-5:] + [texts[-1][: length + 7], "q" + texts[-2]]
        same(spark, texts, length)


def test_empty_and_repeated_ids(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS), 40).count() == 0
    t = "".join(random.Random(5).choice("abcdef") for _ in range(100))
    docs = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (None, "w" + t, "x")], DOCS)
    rows = repeats.remove_repeats(docs, 40).collect()
    assert sorted(r["n_removed"] for r in rows) == [100, 100, 100]


def test_long_texts_of_one_character_and_nulls(spark):
    same(spark, ["a" * 20_000, None, "", "b" + "a" * 500, None, "c" * 399], 400)
