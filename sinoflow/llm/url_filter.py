"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything that touches the pages is a native column expression: n-grams are cut, hashed with XXH64 into ``BUCKETS`` and
looked up in the weights, which are one literal of a fixed size. The model is fitted on the driver from a small table of
labelled URLs (``MAX_LABELLED`` bounds it) with the same hash.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
or the end. A null URL, or one without ``://``, has an empty host and path, and is judged by the model like any other.
Repeated rows are judged each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES, MAX_LABELLED = 4096, (3, 4, 5), 10_000
#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table: unwanted (1) and wanted (0) hosts with paths.
_BAD = "spam-farm cheap-pills casino-bonus free-download-crack adult-cams hot-singles win-prize-now payday-loans replica-watches seo-links click-bait viagra-shop poker-online warez-keygen porn-tube lucky-slots".split()
_GOOD = "news blog docs wiki library museum science university city-council weather recipes travel history garden health-service music".split()
LABELLED = tuple((f"{h}.example.{t}", p, y) for names, y, paths in ((_BAD, 1, ("/buy/now", "/free", "/en/45", "/win.php")), (_GOOD, 0, ("/about", "/article/12", "/en/45", "/fr/7.html"))) for h in names for t in ("com", "org", "net") for p in paths)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(host: str, path: str) -> list[str]:
    """A gram a place and size; h or p in front tells the part."""
    return [k + t[i : i + n] for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in SIZES for i in range(len(t) - n + 1)]


def _cut(part: str, text: Column, n: int) -> Column:
    text = F.concat(F.lit("^"), text, F.lit("$"))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.concat(F.lit(part), F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def grams_of(host: Column, path: Column) -> Column:
    return F.concat(*(_cut(k, t, n) for k, t in (("h", host), ("p", path)) for n in SIZES))


def bucket(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram.encode(), 42) & (BUCKETS - 1)


def train(labelled: Iterable[tuple[str, str, int]] = LABELLED, epochs: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the buckets, the last one the bias. A URL's grams weigh 1 / sqrt(their number) each."""
    rows = list(labelled)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled URLs")
    x, y = np.zeros((len(rows), BUCKETS + 1)), np.array([r[2] for r in rows], float)
    for k, (h, p, _) in enumerate(rows):
        g = [bucket(s) for s in grams(h, p)]
        np.add.at(x[k], g, 1 / np.sqrt(max(1, len(g))))
        x[k, BUCKETS] = 1
    w = np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / max(1, len(y)) + ridge * w)
    return np.round(w, 6)


def score_of(host: Column, path: Column, weights: np.ndarray) -> Column:
    table = F.split(F.lit(",".join(map(repr, map(float, weights)))), ",").cast("array<double>")
    g = grams_of(host, path)
    total = F.aggregate(g, F.lit(0.0), lambda s, x: s + F.element_at(table, (F.xxhash64(x).bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total / F.sqrt(F.greatest(F.lit(1), F.size(g))) + F.lit(float(weights[-1])))))


def judge(pages: DataFrame, rules=RULES, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the model's, higher: block likelier)."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = rows.withColumn("rule", rule).withColumn("_v", verdict).withColumn("score", score_of(F.col("host"), F.col("path"), train() if weights is None else weights))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
