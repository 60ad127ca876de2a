"""Benchmark decontamination as a prefix-filtered set join.

Every run of ``window`` words of a benchmark item is a window (an item of fewer words is one window). A document holds
a window only if it holds all of the window's shingles of two words, so by the prefix bound |w| - ceil(1.0 * |w|) + 1 = 1
it is enough to look each window up by one of them: the rarest by document frequency over the whole corpus (a window of
one word is its own shingle). A document shingle that is some window's prefix gives candidates; the shingle's place in the
window bounds where the window would start and end (position and length bounds), and the words there are compared with
the window's own (exact verification).

The prefix join is a lookup in an index that goes to the executors in blocks of bounded bytes, never as a whole. With more
than one block the corpus is read once a block and the hits of a document are merged by its key.

Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z lower-cased. Null or empty texts have
no words and are clean; items without words have no windows. Repeated items count once by item_id; items whose id is
null count as hits but are not named. Repeated documents get a row each. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

WINDOW = 10
#: Bytes of benchmark text that one block may hold: the bound of what is broadcast (its index holds about 60 times as much in a worker).
BLOCK_BYTES = 2 << 20

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Maps a byte of UTF-8 to itself, to lower case, or to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _LETTERS else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for k in range(max(1, len(words) - size + 1)):
            yield tuple(words[k : k + size])


def shingles_of(words: Sequence[bytes]) -> list[bytes]:
    """Each word with the next one; the word itself where it is alone."""
    return [b"%b %b" % p for p in zip(words, words[1:], strict=False)] or list(words)


def tokens_of(words: list[bytes], alone: bool) -> set[bytes]:
    """All shingles of a document, with its words where ``alone``: windows of one word are looked up by these."""
    return {*shingles_of(words), *words} if alone else set(shingles_of(words))


def build_index(items: Iterable[tuple[int, bytes | None]], frequency: dict[bytes, int], window: int = WINDOW) -> dict:
    """{prefix shingle: {(place in window, words in window): {window: item ids}}}."""
    index: dict = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            s = shingles_of(w)
            k = min(range(len(s)), key=lambda i: (frequency.get(s[i], 0), s[i], i))
            if len(w) == 1:
                index.setdefault(b"", {})
            index.setdefault(s[k], {}).setdefault((k, len(w)), {}).setdefault(b" ".join(w), set()).update(() if item is None else (item,))
    return index


def find(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Where windows occur (from, to in words), and the items they belong to."""
    spans, items, n = [], set(), len(words)
    at_tokens = [(k, s) for k, s in enumerate(shingles_of(words)) if s in index]
    if n > 1 and b"" in index:  # there are windows of one word
        at_tokens += [(k, w) for k, w in enumerate(words) if w in index]
    for at, token in at_tokens:
        for (place, size), known in index[token].items():
            start = at - place
            if start >= 0 and start + size <= n and (of := known.get(b" ".join(words[start : start + size]))) is not None:
                spans.append((start, start + size))
                items |= of
    return spans, items


def covered(spans: Iterable[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def frequency_of(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each shingle of ``vocabulary`` (one block's) occurs, over all documents."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))
    alone = any(b" " not in s for s in vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}
        for b in batches:
            for t in _binary(b, "text"):
                for w in known.value.intersection(tokens_of(words_of(t), alone)):
                    n[w] = n.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return {bytes(r[0]): r[1] for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


SCANNED = "doc_id long, text_md5 string, n_words long, n_hit long, spans array<int>, items array<string>"


def _indexes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[bool, object]]:
    """For each block of the benchmark: whether it is the last, and its broadcast index."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        own = [(r[0], (r[1] or "").encode()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]  # block_bytes bound it
        frequency = frequency_of(docs, {s for _, t in own for s in shingles_of(words_of(t))}) if own else {}
        yield k == blocks - 1, spark.sparkContext.broadcast(build_index(own, frequency, window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside any window's occurrence), items (sorted ids, as strings)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts, scratch = [], Scratch(spark, "leaks")
    for k, (last, index) in enumerate(_indexes(docs, benchmark, window, block_bytes)):
        found = docs.mapInArrow(_scanner(index), SCANNED)
        if last and not parts:
            return found.select("doc_id", "n_words", "n_hit", "items")
        parts.append(scratch.save(found.where("n_hit > 0"), f"block{k}"))
    # More than one block: the spans and items of each document meet, by its id and text.
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("doc_id", "text_md5", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = hits.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), "spans", "items")
    empty = spark.sparkContext.broadcast({})
    every = docs.mapInArrow(_scanner(empty), SCANNED).drop("spans", "items", "n_hit")
    joined = every.join(merged, every["doc_id"].eqNullSafe(merged["_id"]) & (every["text_md5"] == merged["_md5"]), "left")

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            spans = [x or [] for x in d["spans"]]
            n = [covered(zip(x[::2], x[1::2], strict=True)) for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x or [] for x in d["items"]], pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return joined.select("doc_id", "n_words", "spans", "items").mapInArrow(hit, "doc_id long, n_words long, n_hit long, items array<string>")


def _scanner(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for b in batches:
            n, hit, where, which, digest = [], [], [], [], []
            for t in _binary(b, "text"):
                words = words_of(t)
                spans, items = find(words, known)
                n.append(len(words))
                hit.append(covered(spans))
                where.append([x for s in set(spans) for x in s])
                which.append(sorted(map(str, items)))
                digest.append(hashlib.md5(t or b"").hexdigest() if spans or not known else "")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(digest, pa.string()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.string()))],
                ["doc_id", "text_md5", "n_words", "n_hit", "spans", "items"],
            )

    return scan


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark. Each block of the benchmark is one pass."""
    scratch = None
    for k, (last, index) in enumerate(_indexes(docs, benchmark, window, block_bytes)):
        docs = docs.mapInArrow(_filter(index, docs.columns.index("text")), docs.schema)
        if not last:  # the next pass starts from rows in the shared folder
            scratch = scratch or Scratch(docs.sparkSession, "clean")
            docs = scratch.save(docs, f"block{k}")
    return docs


def _filter(index, at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for b in batches:
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            yield b.filter(pa.array([not find(words_of(t), known)[0] for t in texts], pa.bool_()))

    return keep
