"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a fixed list of insults and, learnt from half of the sample, words and word beginnings that mark toxic
texts. Features of a text: density and count of lexicon words, how near second-person words stand to them, shares of capitals,
digits and punctuation, shares of obfuscated words (lexicon words spelled with look-alikes, spaced letters or runs of
one letter), and the length. Trees are grown on histograms of the features under logistic loss; a third of the sample,
not used for the trees, fits the isotonic map from margins to probabilities.

A null text counts as empty and is scored like any other. Repeated rows are scored each. An empty table gives an empty
result; with no labelled rows, or of one label only, every score is the labels' mean (0 without labels). Further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .training import SAMPLE, fitted_rows, labelled_sample, score_texts

# Insults, second-person words, look-alike characters.
LEXICON = frozenset(
    "arse arsehole ass asshole bastard bitch bollocks bullshit clown coward crap cretin cunt dick dickhead dimwit disgusting dumb dumbass dunce "
    "fool freak fuck fucker fucking garbage hate idiot idiotic idiots imbecile jerk kill lame liar loser losers lunatic moron moronic morons "
    "nasty parasite pathetic pig prick retard retarded rubbish scum scumbag shit shithead shut slut stupid sucker suck sucks swine toxic trash "
    "twat ugly useless vermin vile wanker weirdo whore worthless wretch".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre".split())
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": "", ".": "", "-": "", "_": ""})

#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 5
#: Lengths of word beginnings that may enter the learnt lexicon, fewest toxic texts and least toxic share of an entry, and most
#: entries. Of some 100 settings these had the least log loss in threefold cross-validation over labelled rows that may be learnt from.
STEMS, SUPPORT, SHARE, LEARNT = (5, 6), 9, 0.4, 400
N_FEATURES = 17
#: Words whose flags a task remembers.
MEMO = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile("1{4,}")
_RUN = re.compile(r"(.)\1+")
_EDGES = ".,;:!?\"'()[]{}<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PLAIN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace())
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())


def entries(text: str) -> set[str]:
    """What a text offers to the learnt lexicon: its words, and their beginnings (marked by a final ~)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:n] + "~" for w in words for n in STEMS if len(w) >= n}


def choose(counts) -> list[str]:
    """The learnt lexicon from (entry, texts, toxic texts)."""
    good = [(-bad, e) for e, n, bad in counts if bad >= SUPPORT and bad / n >= SHARE]
    return [e for _, e in sorted(good)[:LEARNT]]


class Flags(dict):
    """What each word is, worked out once: 1 insult, 2 learnt, 4 second person, 8 insult spelled with runs of a letter."""

    def __init__(self, learnt: frozenset[str]) -> None:
        super().__init__()
        self.learnt = learnt

    def __reduce__(self):
        return Flags, (self.learnt,)

    def __missing__(self, w: str) -> int:
        known = w in LEXICON
        taught = w in self.learnt or any(w[:k] + "~" in self.learnt for k in STEMS if len(w) >= k)
        run = not known and bool(_RUN.search(w)) and _RUN.sub(r"\1", w) in LEXICON
        if len(self) >= MEMO:
            self.clear()
        self[w] = known + 2 * taught + 4 * (w in SECOND_PERSON) + 8 * run
        return self[w]


def features(text: str, flags: Flags) -> np.ndarray:
    words = _WORD.findall(text.lower())
    n, raw = max(1, len(words)), text.encode()
    size = max(1, len(raw))
    left = lambda out: len(raw) - len(raw.translate(None, out))
    of = np.fromiter((flags[w] for w in words), np.int8, len(words))
    hits, you = np.flatnonzero(of & 3), np.flatnonzero(of & 4)
    kinds = lambda bit: len({words[k] for k in np.flatnonzero(of & bit)})
    near = 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        near = int((np.minimum(np.abs(hits - you[np.maximum(at - 1, 0)]), np.abs(hits - you[np.minimum(at, len(you) - 1)])) <= NEAR).sum())
    tokens = text.split()
    mixed = {w.strip(_EDGES) for w in tokens if not w.isalpha()}
    odd = sum(not w.isalpha() and w.translate(LOOK_ALIKES).lower() in LEXICON for w in mixed)
    spaced = len(_SPACED.findall("".join(["1" if len(w) == 1 else "0" for w in tokens])))
    own = int((of & 1).sum())
    capitals = left(_UPPER)
    return np.array(
        [
            own / n, min(own, 50), kinds(1), len(hits) / n, min(len(hits), 50), kinds(2), near / n, len(you) / n,
            capitals / max(1, left(_LETTERS)), 1 - left(_PLAIN) / size, raw.count(b"!") / size, left(_DIGITS) / size,
            odd / n, np.count_nonzero(of & 8) / n, spaced / n, np.log1p(n), float(hits.max() - hits.min()) / n if len(hits) else 0.0,
        ],
        np.float64,
    )


class Trees:
    """Boosted trees on ``bins`` histogram bins: each tree is flat arrays of feature, threshold and leaf value, depth levels deep."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10, ridge: float = 1.0) -> None:
        self.n, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.grown = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(code, cuts, y - p, p * (1 - p))
            self.grown.append(tree)
            f += self._of(tree, x)
        return self

    def _grow(self, code, cuts, g, h):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            total, weight = g[own].sum(), h[own].sum()
            value[node] = self.rate * total / (weight + self.ridge)
            if 2 * node + 2 >= size or len(own) < 2 * self.least:
                continue
            best = (1e-6, -1, 0)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = code[own, k]
                gl, hl, nl = (np.bincount(bins, w, len(c) + 1).cumsum()[:-1] for w in (g[own], h[own], None))
                gain = gl**2 / (hl + self.ridge) + (total - gl) ** 2 / (weight - hl + self.ridge) - total**2 / (weight + self.ridge)
                gain[(nl < self.least) | (len(own) - nl < self.least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                at[own] = 2 * node + 1 + (code[own, best[1]] > best[2])
        return feature, cut, value

    def _of(self, tree, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._of(t, x) for t in self.grown), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising least-squares fit (pool adjacent violators), linear between them."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, least x, greatest x
    for a, b in zip(x[order], y[order], strict=True):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0], blocks[-1][1] = blocks[-1][0] + b, blocks[-1][1] + 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.array([v for b in blocks for v in (b[0] / b[1],) * 2])


class Toxicity:
    """A fitted model: lexicon, trees and isotonic map, or one mean score where there is nothing to learn from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, learnt: frozenset[str] = frozenset()) -> None:
        self.flags = Flags(learnt)
        self.mean = float(y.mean()) if len(y) else 0.0
        self.trees = None
        held = np.arange(len(y)) % 3 == 2
        if len(set(y[~held])) > 1 and len(set(y[held])) > 1:
            self.trees = Trees().fit(x[~held], y[~held])
            self.at, self.p = isotonic(self.trees.margin(x[held]), y[held])

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.trees:
            return np.full(len(texts), self.mean)
        x = np.stack([features(t, self.flags) for t in texts]).astype(np.float32).astype(np.float64)
        return np.clip(np.interp(self.trees.margin(x), self.at, self.p), 0, 1)


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words and beginnings that mark toxic texts, from sample rows (text, label) that train nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e in entries(t):
                    c = n.setdefault(e, [0, 0])
                    c[0], c[1] = c[0] + 1, c[1] + int(y)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([c[0] for c in n.values()], pa.int64()), pa.array([c[1] for c in n.values()], pa.int64())], ["entry", "n", "bad"])

    counts = sample.select("text", "label").mapInArrow(run, "entry string, n long, bad long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = counts.where((F.col("bad") >= SUPPORT) & (F.col("bad") >= SHARE * F.col("n"))).orderBy(F.desc("bad"), "entry").limit(LEARNT)
    return frozenset(choose(tuple(r) for r in top.collect()))


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> Toxicity:
    """Half of the sample teaches the lexicon, the other half trains the trees and the calibration."""
    rows = Scratch(docs.sparkSession, "toxic").save(labelled_sample(docs, labels, "toxic", keep, sample), "sample")
    learnt = learn_lexicon(rows.where("at & 1 = 0"))
    flags = Flags(learnt)
    x, y = fitted_rows(rows.where("at & 1 = 1"), lambda t: features(t, flags))
    return Toxicity(np.stack(x) if x else np.zeros((0, N_FEATURES)), y, learnt)


def toxicity(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; learnt from labels that ``keep`` allows."""
    model = fit(docs, labels, keep, sample)  # a few kB; it goes with the function, by value
    return score_texts(docs, lambda texts: model.score(texts))
