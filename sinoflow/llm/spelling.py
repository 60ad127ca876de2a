"""Spelling variants: words of a corpus that differ by one code point, grouped under their most frequent form.

Two words that differ by one inserted, deleted or replaced code point agree exactly in their first or in their last half.
For a pair whose shorter word has k code points the halves are its first k // 2 and its last k - k // 2. So each word is
dealt out four times: forwards and reversed, as the shorter or equal and as the longer one of a pair, by direction, k and
that half; words that are near meet in a task. There a minimal acyclic automaton of the words (forwards or reversed)
with perfect-hash numbers is walked: the half exactly, the rest with one error. What both directions find counts once.

Automata are built and walked by NumPy on all words of a run of halves at a time, so memory is bounded by ``CELLS`` code
points and one half's words. A half of more than ``MOST`` words is cut into tiles of askers and asked, which are tasks of
their own. Words are counted with partial aggregation; no word list comes to the driver.

Nulls: a null text has no words, a null doc_id counts as an empty string where ids are hashed. Repeated rows count each
time. Empty tables and texts without words give no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged_with, partitions, text_of

#: Letters that words are runs of.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Code points of words from which a run of halves is closed and walked; a bound of memory, not of the result.
CELLS = 400_000
#: Words of one half that meet whole; a larger half is cut into tiles.
MOST = 30_000
LINKS = "word string, near string, n long, near_n long"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of letters of ``shortest`` code points or more that occur ``least`` times or more.

    Where ``slip`` divides the crc32 of ``doc_id:run`` the run loses its code point crc32 % length first; 0: nowhere.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= shortest).select("id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if slip:
        hit = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
        runs = runs.withColumn("h", hit)
        word = F.when(F.col("h") % slip != 0, F.col("run")).otherwise(F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
    counts = runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of a sorted matrix of words (a row a word, code points, 0 after its end), with word numbers.

    An edge has a label, a target and how many words of its state come before those it leads to; their sum along a
    word's path is the word's number. States are merged from the leaves up: those whose edges and finality agree are one.
    """

    def __init__(self, words: np.ndarray) -> None:
        n, wide = words.shape
        new = np.ones((n, wide + 1), bool)  # row i begins a node at depth d
        new[:, 0] = False
        new[0, 0] = True
        if n > 1:
            new[1:, 1:] = np.logical_or.accumulate(words[1:] != words[:-1], axis=1)
        new[:, 1:] &= words > 0
        size = (words > 0).sum(1)
        node = np.cumsum(new, axis=0) - 1  # a node's number within its depth
        first = np.concatenate([[0], np.cumsum(new.sum(0))])
        row, depth = np.nonzero(new)
        at = first[depth] + node[row, depth]
        many = int(first[-1])
        label, parent = np.zeros(many, np.int64), np.full(many, -1)
        inner = depth > 0
        label[at[inner]] = words[row[inner], depth[inner] - 1]
        parent[at[inner]] = first[depth[inner] - 1] + node[row[inner], depth[inner] - 1]
        final = np.zeros(many, bool)
        final[first[size] + node[np.arange(n), size]] = True
        count = np.zeros(many, np.int64)
        height = np.zeros(many, np.int64)
        count[final] = 1
        for d in range(wide, 0, -1):
            own = np.arange(first[d], first[d + 1])
            np.add.at(count, parent[own], count[own])
            np.maximum.at(height, parent[own], height[own] + 1)
        # Edges in order of parent and label: nodes of a depth are numbered in order of words, so children stand in order.
        child = np.arange(1, many)
        child = child[np.argsort(parent[1:], kind="stable")]
        degree = np.bincount(parent[1:], minlength=many) if many > 1 else np.zeros(many, np.int64)
        begin = np.concatenate([[0], np.cumsum(degree)])
        state = np.full(many, -1)
        self.final, keep, states = [], [], 0
        by_height = np.argsort(height, kind="stable")
        for own in np.split(by_height, np.cumsum(np.bincount(height))[:-1]):
            kind = final[own].astype(np.int64)
            for k in range(int(degree[own].max())):
                has = degree[own] > k
                edge = child[begin[own[has]] + k]
                mark = np.unique(kind[has] * (1 << 21) + label[edge], return_inverse=True)[1]
                kind[has] = np.unique(mark * (states + 1) + state[edge], return_inverse=True)[1] + kind.max() + 1
            which, at, kind = np.unique(kind, return_index=True, return_inverse=True)
            state[own] = states + kind
            keep.append(own[at])
            self.final.append(final[own[at]])
            states += len(which)
        keep = np.concatenate(keep)  # a node a state, in order of states
        self.final = np.concatenate(self.final)
        self.degree = degree[keep]
        self.begin = np.concatenate([[0], np.cumsum(self.degree)])[:-1]
        edge = child[np.repeat(begin[keep], self.degree) + np.arange(self.degree.sum()) - np.repeat(self.begin, self.degree)]
        self.label, self.target = label[edge], state[edge]
        before = np.cumsum(count[edge]) - count[edge]
        owner = np.repeat(np.arange(states), self.degree)
        self.skip = before - (before[self.begin[owner]] if len(edge) else 0) + self.final[owner]
        self.key = owner * (1 << 21) + self.label
        self.root, self.states, self.words = int(state[0]), states, n

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of ``state`` have the edge, its target, its words before)."""
        if not len(self.key):
            return np.zeros(len(state), bool), state[:0], state[:0]
        want = state * (1 << 21) + letter
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        has = self.key[at] == want
        return has, self.target[at[has]], self.skip[at[has]]

    def fan(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``state``, edge) of all edges."""
        of = np.repeat(np.arange(len(state)), self.degree[state])
        edge = np.arange(len(of)) - np.repeat(np.cumsum(self.degree[state]) - self.degree[state], self.degree[state]) + self.begin[state[of]]
        return of, edge


def one_error(tree: Automaton, asked: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, word number) for the tree's words that differ by one letter more or one other letter after ``exact`` letters.

    ``asked`` is a matrix of words of one length. Walks without an error go on beside those that have spent it.
    """
    n, size = asked.shape
    none = np.zeros(0, np.int64)
    row, state, number = np.arange(n), np.full(n, tree.root), np.zeros(n, np.int64)
    spent, settled = (none, none, none), 0
    for t in range(size + 1):
        more = (none, none, none)
        if t >= exact:
            of, edge = tree.fan(state)
            grown = (row[of], tree.target[edge], number[of] + tree.skip[edge])  # a letter more
            spent = tuple(np.concatenate(x) for x in zip(spent, grown, strict=True))
            if t < size:
                other = tree.label[edge] != asked[row[of], t]
                more = tuple(x[other] for x in grown)  # another letter in its place
        if t == size:
            break
        has, target, skip = tree.step(spent[1], asked[spent[0], t])
        spent = tuple(np.concatenate(x) for x in zip((spent[0][has], target, spent[2][has] + skip), more, strict=True))
        if len(spent[0]) > 2 * settled + 1000:  # errors at several places of a run of one letter lead to one word
            once = np.unique((spent[0] * tree.states + spent[1]) * tree.words + spent[2], return_index=True)[1]
            spent, settled = tuple(x[once] for x in spent), len(once)
        has, target, skip = tree.step(state, asked[row, t])
        row, state, number = row[has], target, number[has] + skip
    done = tree.final[spent[1]]
    return spent[0][done], spent[2][done]


def matrix(words: list[str], wide: int) -> np.ndarray:
    out = np.zeros((len(words), wide), np.int64)
    for size in {len(w) for w in words}:
        own = [k for k, w in enumerate(words) if len(w) == size]
        out[own, :size] = np.frombuffer("".join(words[k] for k in own).encode("utf-32-le"), "<u4").reshape(-1, size)
    return out


def near_words(letters: list[str], asks: np.ndarray, told: np.ndarray, k: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into ``letters``: words of ``k`` letters that ask, and words told of that are near after an exact half."""
    own, asking = np.flatnonzero(told), np.array([a and len(w) == k for w, a in zip(letters, asks, strict=True)], bool)
    asking = np.flatnonzero(asking)
    if not len(own) or not len(asking):
        return own[:0], own[:0]
    rows = matrix([letters[i] for i in own], k + 1)
    order = np.lexsort(rows.T[::-1])
    tree = Automaton(rows[order])
    a, number = one_error(tree, matrix([letters[i] for i in asking], k), k - k // 2 if backward else k // 2)
    return asking[a], own[order[number]]


def deal(words: DataFrame, shortest: int) -> DataFrame:
    """(backward, k, half, letters, n): each word as the shorter and as the longer one of a pair, in both directions."""
    size = F.length("word")
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"), size.alias("size"))
    both = both.select("n", "backward", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")).alias("letters"), F.explode(F.array("size", F.col("size") - 1)).alias("k")).where(F.col("k") >= shortest)
    half = F.when(F.col("backward"), F.col("k") - F.floor(F.col("k") / 2)).otherwise(F.floor(F.col("k") / 2)).cast("int")
    return both.select("backward", "k", F.substring("letters", F.lit(1), half).alias("half"), "letters", "n")


def tiled(rows: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``rows`` with (tile, asks, told): all in one tile, but for halves of more than ``most`` words."""
    whole = [F.lit(0).alias("tile"), F.lit(True).alias("asks"), F.lit(True).alias("told")]
    over = scratch.save(rows.groupBy("backward", "k", "half").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most), "over")
    if over.isEmpty():
        return rows.select("*", *whole)
    over = over.select(F.col("backward").alias("_b"), F.col("k").alias("_k"), F.col("half").alias("_h"), F.ceil(F.col("words") / most).cast("int").alias("parts"))
    met = merged_with(rows, over, (rows["backward"] == over["_b"]) & (rows["k"] == over["_k"]) & (rows["half"] == over["_h"]), "left")
    own = F.pmod(F.xxhash64("letters"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # Tile (i, j): askers of part i meet what is told of part j.
    ask = F.transform(every, lambda j: F.struct((own * F.col("parts") + j).alias("tile"), F.lit(True).alias("asks"), (own == j).alias("told")))
    tell = F.transform(F.filter(every, lambda i: i != own), lambda i: F.struct((i * F.col("parts") + own).alias("tile"), F.lit(False).alias("asks"), F.lit(True).alias("told")))
    one = F.array(F.struct(*whole))
    out = met.withColumn("t", F.explode(F.when(F.col("parts").isNull(), one).otherwise(F.concat(ask, tell))))
    return out.select(*rows.columns, "t.tile", "t.asks", "t.told")


def links(words: DataFrame, scratch: Scratch, shortest: int = 5, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """(word, near, n, near_n), both ways round, of all pairs of ``words`` (word, n) that are near."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: columns (backward, k, letters, n, asks, told) of one direction and k."""
        backward, k = rows[0][0][0], rows[0][1][0]
        letters, n, asks, told = ([x for r in rows for x in r[c]] for c in (2, 3, 4, 5))
        a, b = near_words(letters, np.array(asks, bool), np.array(told, bool), k, backward)
        turn = (lambda w: w[::-1]) if backward else (lambda w: w)
        columns = [[turn(letters[i]) for i in a], [turn(letters[i]) for i in b], [n[i] for i in a], [n[i] for i in b]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["word", "near", "n", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_cells, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            c = [b.column(k).to_pylist() for k in range(b.num_columns)]
            backward, size, half, tile, letters, n, asks, told = c
            key = list(zip(backward, size, half, tile, strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key[lo] != last and (held_cells >= cells or last[:2] != key[lo][:2] or last[3] or key[lo][3]):
                    yield flush(held)
                    held, held_cells = [], 0
                held.append(tuple(x[lo:hi] for x in (backward, size, letters, n, asks, told)))
                held_cells += (hi - lo) * size[lo]
                last = key[lo]
        if held:
            yield flush(held)

    rows = tiled(deal(words, shortest), scratch, most)
    order = ["backward", "k", "half", "tile"]
    met = rows.repartition(partitions(scratch.spark), *order).sortWithinPartitions(*order).select(*order, "letters", "n", "asks", "told")
    found = met.mapInArrow(run, LINKS)
    turned = F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n"))
    return found.select(F.inline(F.array(F.struct(*found.columns), turned))).distinct()


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form, root): ``form`` followed to the last, by pointers that double their reach each round; counts double along a chain, so rounds are few."""
    now, k = scratch.save(forms.select("word", "form", F.coalesce("form", "word").alias("root")), "roots0"), 0
    while True:
        to = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = merged_with(now, to, now["root"] == to["_w"])
        after = scratch.save(step.select("word", "form", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), f"roots{k + 1}")
        if k:
            scratch.drop(f"roots{k}")
        moved = not after.where("moved").isEmpty()
        now, k = after.drop("moved"), k + 1
        if not moved:
            return now


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int = 97, factor: int = 2, most: int = MOST, cells: int = CELLS) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest count (ties: the least word) if that is ``factor`` times its own or more;
    root follows forms to the last.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, shortest, least, slip), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = links(words, scratch, shortest, most, cells).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("_w"), "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))
    met = merged_with(words, near, words["word"] == near["_w"], "left")
    holds = F.col("near_n") >= F.col("n") * factor
    all_ = scratch.save(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(holds, F.col("near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(all_, scratch).select(F.col("word").alias("_w"), "root")
    return merged_with(all_, ends, all_["word"] == ends["_w"]).select("word", "form", "root", "n", "n_near", "form_n")
