"""Mixing sources to target weights by the cube method.

Each source gets a target number of words. A document's rate is target / source size: its whole part is how often the
document is taken for certain, the rest is an inclusion probability. Within each source these probabilities move along
the null space of two constraints (words, documents) until each is 0 or 1, so both totals stay what they were
(Deville and Tille 2004; the fast flight of Chauvet and Tille 2006, which looks at one unit more than there are
constraints). Blocks of a few thousand documents move on their own, wherever they are; each leaves two undecided units
at most, and these meet in blocks again until one block a source remains. For its two units to land near the target, one
undecided document of each size class (powers of two) of a source stays out of the flight and keeps its probability: all
cases of these and the two are tried, for the nearest word total among those that keep the document total.

Nulls: a null text has size 0, a null source is a source of its own and the last in order. Repeated rows are units of
their own. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_name, text_of

#: Units that one task moves together; a bound of memory, not of the result.
BLOCK = 4096
#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
EPS = 1e-9
#: Size classes of which a document stays out of the flight; larger documents are of the last one.
CLASSES = 22
UNITS = "row long, doc_id long, digest long, source string, size long, base long, pi double"


def size_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, target): ``share`` of all words dealt by weight, no source above ``cap`` times its size.

    Resharing the excess until none is above ends at min(cap * size, level * weight) with one level for all. With
    sources in order of cap * size / weight the capped ones come first, so running sums give the level. The windows
    run over one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    by = by.withColumn("level", (everything * F.lit(float(share)) - before) / rest)
    by = by.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True)
    by = by.withColumn("level", level.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: list[float], size: list[float], coin: Iterator[float]) -> list[float]:
    """Moves the probabilities until two at most lie strictly between 0 and 1; sums of pi and of pi * size stay.

    Units come in the order given; three undecided ones at a time share a direction that changes neither sum.
    """
    pi = list(pi)
    open_: list[int] = []
    for k in range(len(pi)):
        if EPS < pi[k] < 1 - EPS:
            open_.append(k)
        else:
            pi[k] = float(round(pi[k]))
            continue
        while len(open_) == 3 or (len(open_) == 2 and size[open_[0]] == size[open_[1]]):
            z = [size[i] for i in open_]
            if len(open_) == 2 or z[0] == z[1] == z[2]:
                u = [1.0, -1.0, 0.0][: len(open_)]
            else:
                u = [z[1] - z[2], z[2] - z[0], z[0] - z[1]]
            up = min((1 - pi[i]) / d if d > 0 else pi[i] / -d for i, d in zip(open_, u, strict=True) if d)
            down = min(pi[i] / d if d > 0 else (1 - pi[i]) / -d for i, d in zip(open_, u, strict=True) if d)
            step = up if next(coin) * (up + down) < down else -down
            for i, d in zip(open_, u, strict=True):
                pi[i] += step * d
                if pi[i] < EPS or pi[i] > 1 - EPS:
                    pi[i] = float(round(pi[i]))
            open_ = [i for i in open_ if 0 < pi[i] < 1]
    return pi


def landing(pi: list[float], size: list[float]) -> list[float]:
    """Decides all that is undecided: the nearest word total of those whose document total is off by less than one, then the nearest of these.

    All cases are tried, as pairs of cases of two halves; there are few units (``CLASSES`` and two).
    """
    open_ = [k for k, p in enumerate(pi) if 0 < p < 1]
    words, docs = sum(pi[k] * size[k] for k in open_), sum(pi[k] for k in open_)
    halves = []
    for half in (open_[: len(open_) // 2], open_[len(open_) // 2 :]):
        case = np.array(list(product((0, 1), repeat=len(half))), int).reshape(1 << len(half), -1)
        halves.append((case, case.sum(1), case @ np.array([size[k] for k in half], float).reshape(-1)))
    (first, n, w), (second, m, v) = halves
    best = None
    for total in {int(np.floor(docs + EPS)), int(np.ceil(docs - EPS))}:
        for k in range(int(n.max()) + 1):
            own, other = np.flatnonzero(n == k), np.flatnonzero(m == total - k)
            if not len(own) or not len(other):
                continue
            other = other[np.argsort(v[other], kind="stable")]
            at = np.searchsorted(v[other], words - w[own])
            for near in (np.clip(at, 0, len(other) - 1), np.clip(at - 1, 0, len(other) - 1)):
                off = np.abs(w[own] + v[other[near]] - words)
                j = int(off.argmin())
                case = (round(float(off[j]), 6), abs(total - docs), own[j], other[near[j]])
                if best is None or case < best:
                    best = case
    pi = list(pi)
    for k, x in zip(open_, [*first[best[2]], *second[best[3]]] if open_ else [], strict=True):
        pi[k] = float(x)
    return pi


def coins(seed: str) -> Iterator[float]:
    import random

    r = random.Random(seed)
    while True:
        yield r.random()


def balance(units: DataFrame, scratch: Scratch, level: int, blocks: Column, last: bool, most: int, seed: int) -> DataFrame:
    """One round: each block of each source moves; in the last round there is one block a source, which is landed.

    Blocks go by id, size and text. One that has over four times ``most`` units for all that (rows repeated as a whole)
    is cut further by row number.
    """
    block = F.pmod(F.xxhash64("doc_id", "size", "digest", F.lit(seed + level)), blocks.cast("long"))
    units = units.select("row", "doc_id", "digest", "source", "size", "base", "pi", "kept", block.alias("block"))
    over = scratch.save(units.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * most), f"over{level}")
    part = F.lit(0).cast("long")
    if not last and not over.isEmpty():
        over = over.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "n")
        units = units.join(over, units["source"].eqNullSafe(over["_s"]) & (units["block"] == over["_b"]), "left")
        part = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / most).cast("long")), F.lit(0))

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "digest", "pi", "row"], ascending=[False, True, True, True, True], kind="stable", na_position="first")
        where = f"{seed}/{level}/{pdf['source'].iloc[0]}/{pdf['block'].iloc[0]}/{pdf['part'].iloc[0]}"
        size = [float(x) for x in pdf["size"]]
        pi, kept = [float(x) for x in pdf["pi"]], [bool(k) for k in pdf["kept"]]
        flown = iter(flight([p for p, k in zip(pi, kept, strict=True) if not k], [z for z, k in zip(size, kept, strict=True) if not k], coins(where)))
        pi = [p if k else next(flown) for p, k in zip(pi, kept, strict=True)]
        pdf["pi"] = landing(pi, size) if last else pi
        return pdf[["row", "doc_id", "digest", "source", "size", "base", "pi"]]

    return units.withColumn("part", part.cast("long")).groupBy("source", "block", "part").applyInPandas(move, UNITS)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, seed: int = 11, row: str | None = None) -> DataFrame:
    """One row a document: row, doc_id, source, size, source_size, target, copies (how often the mix takes it), taken.

    ``row`` names a column of ``docs`` that tells rows apart; without one they are numbered here.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sizes = scratch.save(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("digest"), F.col("source").cast("string").alias("source"), size_of().alias("size")), "sizes")
    targets = scratch.save(source_targets(sizes, share, cap, weights), "targets")
    t = targets.select(F.col("source").alias("_s"), "source_size", "n_docs", "target")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    units = sizes.join(t, sizes["source"].eqNullSafe(t["_s"])).withColumn("base", F.floor(rate)).withColumn("pi", rate - F.floor(rate))
    units = scratch.save(units.select("row", "doc_id", "digest", "source", "size", "base", "pi"), "units")
    open_ = units.where((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS) & (F.col("size") > 0))
    least = F.min(F.struct("digest", "doc_id", "row", "size", "base", "pi")).alias("u")
    kept = open_.groupBy("source", F.least(F.floor(F.log2("size")), F.lit(CLASSES - 1)).alias("class")).agg(least)
    kept = scratch.save(kept.select("u.row", "u.doc_id", "u.digest", "source", "u.size", "u.base", "u.pi", F.lit(True).alias("kept")), "kept")
    flying = units.withColumn("kept", F.lit(False)).join(kept.select("row").hint("merge"), "row", "left_anti")
    counts = targets.select(F.col("source").alias("_s"), "n_docs")
    with_counts = lambda df: df.join(counts, df["source"].eqNullSafe(counts["_s"]))
    units = with_counts(flying)
    most = targets.agg(F.max("n_docs")).first()[0] or 0  # one number
    done, level = [], 0
    left = -(-most // block)  # blocks of the largest source
    n = F.ceil(F.col("n_docs") / block)
    while True:
        last = left <= 1
        if last:
            units = units.select(*kept.columns).unionByName(kept)
        moved = scratch.save(balance(units, scratch, level, F.lit(1) if last else n, last, block, seed), f"level{level}")
        if last:
            done.append(moved)
            break
        done.append(moved.where("pi = 0 or pi = 1"))
        # Two undecided units at most come from each block.
        n = F.greatest(F.lit(1), F.ceil(n * 2 / block))
        left = max(1, -(-left * 2 // block))
        units = with_counts(moved.where("pi > 0 and pi < 1").withColumn("kept", F.lit(False)))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    copies = (F.col("base") + F.col("pi")).cast("long")
    return out.join(t, out["source"].eqNullSafe(t["_s"])).select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, columns unchanged. Rows are numbered once, in a written table."""
    scratch, row = Scratch(docs.sparkSession, "taken"), free_name(docs, "row")
    rows = scratch.save_bucketed(docs.withColumn(row, F.monotonically_increasing_id()), "rows", row)
    taken = mix(rows, row=row).where("copies > 0").select(F.col("row").alias(row), F.sequence(F.lit(1), F.col("copies").cast("int")).alias("n"))
    n = free_name(rows, "n")
    return rows.join(scratch.save(taken.withColumnRenamed("n", n), "copies"), row).withColumn(n, F.explode(n)).select(docs.columns)
