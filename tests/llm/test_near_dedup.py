"""Near-dedup keeps rows, whatever their ids."""

import random

from sinoflow.llm import simhash
from sinoflow.llm.common import Scratch


def test_null_and_repeated_ids(spark):
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white", "north south east west up down")
    rows = [(None, a), (None, b), (None, b), (7, c), (3, d), (7, d), (9, a + " "), (8, b), (1, b)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("9", a + " "), ("1", b), ("7", c), ("3", d)])
    none = [(None, a), (None, c), (None, a)]
    assert sorted(r["text"] for r in simhash.one_of_each(spark.createDataFrame(none, "doc_id long, text string")).collect()) == sorted([a, c])


def crowd(spark):
    """300 pairs of sketches, 14 bits apart, near in the first segment only, which all 600 share but for one bit of some."""
    r, rows = random.Random(3), []
    for k in range(300):
        a = [r.getrandbits(64) for _ in range(4)]
        a[0] = a[0] >> 32 << 32 | 0xABCD0000
        b = [x ^ 0x30000 ^ (0x300 << 32) for x in a]
        b[0] = a[0] ^ (0x300 << 32) ^ (k % 3 == 0)
        rows += [(2 * k, *a), (2 * k + 1, *b)]
    signed = [(g, *(x - (x >> 63 << 64) for x in f)) for g, *f in rows]
    return spark.createDataFrame(signed, "gid long, f0 long, f1 long, f2 long, f3 long")


def test_crowded_entries_lose_no_link(spark):
    rows = crowd(spark)
    for size, tile in ((8, 512), (8, 50), (10_000, 512)):  # the last one is no crowd: all pairs
        got = simhash.similar(rows, 4, 39, Scratch(spark, "test"), size, tile=tile).collect()
        assert sorted((x["gid"], x["component"]) for x in got) == [(k, k // 2 * 2) for k in range(600)]


def shingles(text, words=5):
    w = (text or "").lower().split()
    return frozenset(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)])


def test_recall_at_the_stated_similarity(spark):
    """Of all pairs of distinct texts of sf0.1 with a similarity of 0.8 or more, nine in ten lose one of the two; what goes is like something."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).select("doc_id").collect()}
    sets = {t: shingles(t) for t in texts if t.split()}
    holders = {}
    for t, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(t)
    common = {}
    for own in holders.values():
        for i, a in enumerate(own if len(own) <= 200 else []):  # what more texts share makes no pair of this similarity here
            for b in own[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    alike = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in common.items()}
    pairs = [p for p, s in alike.items() if s >= 0.8]
    stays = lambda t: any(d in kept for d in texts[t])
    met = sum(not (stays(a) and stays(b)) for a, b in pairs)
    assert len(pairs) > 30 and met >= 0.9 * len(pairs), (met, len(pairs))
    best = {}
    for (a, b), s in alike.items():
        best[a], best[b] = max(s, best.get(a, 0)), max(s, best.get(b, 0))
    wrong = [(round(best.get(t, 0), 3), len(sets[t]), t[:80]) for t in sets if not stays(t) and best.get(t, 0) < 0.7]
    assert not wrong, (len(wrong), met, len(pairs), wrong[:5])
