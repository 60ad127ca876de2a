"""Quality by attention-based multiple-instance learning (gated attention, Ilse et al. 2018).

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by shape features (capitals, symbols,
repeats, word lengths, function words) and a learnt hidden layer; gated attention weights, learnt from document labels
alone, average the encoded passages, and a logistic unit scores that average. Every passage of a text is read.

A null text counts as empty: one empty passage. Repeated rows are scored each. An empty table gives an empty result;
with no labelled rows, or of one label only, every score is the labels' mean (1 without labels, so nothing is rejected
unlearnt). Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .training import SAMPLE, fitted_rows, labelled_sample, score_texts

PASSAGE = 60
N_FEATURES = 16
HIDDEN, GATES, EPOCHS, BATCH = 16, 8, 40, 64
#: Bytes of a text whose words are held at a time, up to the next cut.
PIECE = 1 << 20
_CUT = re.compile(rb"(?<!\n)[ \n]")  # where one word ends for certain: a line break goes with what stands behind it
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SIGN = frozenset(_SIGNS[k : k + 1] for k in range(len(_SIGNS)))
_CODE = b"{}<>=#@\\/&$%*!"
_END = (b".", b",", b";", b"?")


def encode(words: list[bytes]) -> list[float]:
    """Shape features of one passage, over its UTF-8 bytes; a word that begins a line carries the line break in front."""
    joined = b"".join(words)
    n, size = max(1, len(words)), max(1, len(joined))
    count = lambda out: len(joined) - len(joined.translate(None, out))
    upper, digits, signs, lines = count(_UPPER), count(_DIGITS), count(_SIGNS), joined.count(b"\n")
    lens = [len(w) for w in words] or [0]
    mean = sum(lens) / len(lens)
    low = [w.lower() for w in words]
    return [
        upper / max(1, size - digits - signs), sum(map(bytes.isupper, words)) / n, signs / size, digits / size,
        sum(w[-2:-1] in _SIGN for w in words) / n, len(set(low)) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, mean / 10,
        (sum(x * x for x in lens) / len(lens) - mean * mean) ** 0.5 / 10, sum(x > 20 for x in lens) / n,
        lines / n, joined.count(b"|") / n, sum(w.endswith(_END) for w in words) / n,
        sum(x < 4 for x in lens) / n, count(_CODE) / size, n / PASSAGE,
    ]


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    lo = 0
    while lo < len(raw):
        cut = _CUT.search(raw, lo + PIECE)
        hi = cut.start() if cut else len(raw)
        words = raw[lo:hi].replace(b"\n", b" \n").replace(b"\n ", b"\n").split(b" ")
        yield [w for w in words if w.strip()]
        lo = hi


def passages(text: str, size: int = PASSAGE) -> np.ndarray:
    """One row of features a passage, at least one."""
    out, left = [], []
    for words in words_of(text.encode()):
        words = left + words
        whole = len(words) // size * size
        out += [np.array([encode(words[k : k + size]) for k in range(0, whole, size)], np.float64)] if whole else []
        left = words[whole:]
    if left or not out:
        out.append(np.array([encode(left)], np.float64))
    return np.concatenate(out)


class Attention:
    """The network and its training; ``w`` holds all weights."""

    def __init__(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 7) -> None:
        self.mean = float(y.mean()) if len(y) else 1.0
        self.w = None
        if len(set(y)) < 2:
            return
        every = np.concatenate(bags)
        self.mu, self.sd = every.mean(0), every.std(0) + 1e-3
        r = np.random.default_rng(seed)
        shape = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": ()}
        self.w = {k: r.normal(0, 0.3, s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
        m, v, step = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2)), None, 0
        m, v = m
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                g = self._gradient([bags[i] for i in own], y[own])
                step += 1
                for name in g:  # Adam
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    self.w[name] = self.w[name] - 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    def _forward(self, bags: list[np.ndarray]):
        w, first = self.w, np.cumsum([0, *(len(b) for b in bags)])[:-1]
        of = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        x = np.clip((np.concatenate(bags) - self.mu) / self.sd, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        alpha = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return of, first, x, h, t, s, alpha, z, p

    def _gradient(self, bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        of, first, x, h, t, s, alpha, z, p = self._forward(bags)
        dl = (p - y) / len(y)
        dz = dl[:, None] * w["c"]
        da = (h * dz[of]).sum(1)
        de = alpha * (da - np.add.reduceat(alpha * da, first)[of])
        dts = de[:, None] * w["a"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = alpha[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T
        dx = dh * (1 - h**2)
        out = {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dl, "d": dl.sum()}
        return {k: g + 1e-4 * w[k] for k, g in out.items()}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.mean)
        return self._forward([passages(t).astype(np.float32).astype(np.float64) for t in texts])[-1]


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> Attention:
    x, y = fitted_rows(labelled_sample(docs, labels, "quality", keep, sample), passages)
    return Attention([b.reshape(-1, N_FEATURES) for b in x], y)


def quality(docs: DataFrame, labels: DataFrame, keep, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; learnt from labels that ``keep`` allows."""
    model = fit(docs, labels, keep, sample)  # a few kB; it goes with the function, by value
    return score_texts(docs, lambda texts: model.score(texts))


def good_documents(docs: DataFrame, labels: DataFrame, keep, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more. Workers get the session's batches: the plan runs later."""
    import pyarrow as pa

    model = fit(docs, labels, keep, sample)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = model.score([t or "" for t in b.column(at).cast(pa.large_string()).to_pylist()]) if b.num_rows else np.zeros(0)
            yield b.filter(pa.array(s >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
