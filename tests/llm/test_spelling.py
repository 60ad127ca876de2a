"""Spelling variants against all pairs, on small texts and odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sinoflow.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, shortest=5, least=3):
    """Every word's row, by all pairs of words of like length."""
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if k >= least and len(w) >= shortest}
    by = {}
    for w in n:  # words that are near share what is left without one letter
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    links = {w: set() for w in n}
    for group in by.values():
        for a in group:
            links[a] |= {b for b in group if near(a, b)}
    form = {}
    for w in n:
        top = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(links[w]), n.get(form[w]))
    return out


def rows_of(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def test_automaton_is_minimal_and_numbers_words():
    r = random.Random(2)
    for _ in range(50):
        k = r.choice([5, 6, 9])
        words = sorted({"".join(r.choice("abé") for _ in range(r.choice([k, k + 1]))) for _ in range(r.choice([1, 5, 60]))})
        tree = spelling.Automaton(spelling.matrix(words, k + 1))
        assert tree.states == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]})
        for number, w in enumerate(words):
            state, at = np.array([tree.root]), 0
            for c in w:
                has, state, skip = tree.step(state, np.array([ord(c)]))
                at += int(skip[0])
            assert at == number and tree.final[state[0]]


@pytest.mark.parametrize(("most", "cells"), [(30_000, 400_000), (3, 1), (7, 60)])
def test_as_all_pairs(spark, most, cells):
    r = random.Random(most)
    words = ["".join(r.choice("abcdéÿ") for _ in range(r.randint(4, 8))) for _ in range(60)]
    words += ["".join(c if r.random() > 0.2 else r.choice(["", "x", c + c]) for c in w) for w in words * 2]
    docs = [(k, " ".join(r.choice([w, w.upper(), w.capitalize()]) for w in r.choices(words, weights=[1 + k % 9 for k in range(len(words))], k=120))) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    assert rows_of(spelling.variants(df, most=most, cells=cells)) == want and sum(v[3] > 0 for v in want.values()) > 20


def test_odd_inputs(spark):
    hot = "common " * 5 + "commom commom commom "
    long = "a" * 3000
    docs = [(k, hot) for k in range(40)] + [(None, hot), (None, None), (None, ""), (3, "Ünder ünder under UNDER under"), (3, "Ünder ünder under UNDER under"), (9, f"{long} {long}a {long} {long}a {long} {long}a b{long} b{long} b{long}"), (10, "1234 a-b ×÷ words5words words words")]
    df = spark.createDataFrame([(d, t, "own", "own", "own") for d, t in docs], "doc_id long, text string, word string, n string, form string")
    assert rows_of(spelling.variants(df)) == plain(docs)
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(df.where("text is null or text = ''")).count() == 0
    many = [(k, f"aaaaa{x}{y} " * 3) for k, (x, y) in enumerate((x, y) for x in "abcdefgh" for y in "abcdefgh")]
    assert rows_of(spelling.variants(spark.createDataFrame(many, "doc_id long, text string"), most=10, cells=20)) == plain(many)


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").collect()]
    assert rows_of(queries.op12_spelling(spark, small)) == plain(docs)
