"""Removal of repeated byte strings by bucket-pointer refinement of a sparse suffix array.

Which suffixes are sorted: those at *anchors*. Of each ``window`` of start positions the one whose first bytes hash least
is an anchor, so equal strings of ``length`` bytes have equal anchors at equal offsets, as far as the windows lie in them.
Each start position belongs to the anchor of the window that begins there.

1. Initial buckets: anchors go by the q-gram of ``gram`` bytes there.
2. Refinement: an anchor's bucket is refined by the bucket of the next anchor and its distance, and the result by the
   refined bucket two anchors on, so pointers and depth double each round and later buckets are used as they are refined
   (four anchors in two rounds; a string of ``length`` bytes has room for them). Before each round buckets of one go,
   and with them every anchor whose pointer leads to one.
3. Buckets are told apart by all bytes that a string around the anchor can reach. Two of one context settle all strings
   around them. A context met once, and one suffix of each other context of its bucket, are refined at the offsets
   before the anchor: in blocks of offsets first, by the bytes that all strings of a block share (met once: none
   repeats) and by those that they cover (met twice: all do), then one by one in the blocks left over and one block of
   each other cover of their bucket.

Buckets have 64-bit names, which only filter; what decides (contexts, covers, strings) is told by XXH3 digests of 128
bits over the bytes themselves. Every step counts by key with partial aggregation and marks members by a join that can
be split, so no bucket is gathered in one task, and of a bucket of many copies one suffix goes to step 3. Texts are dealt
out by row number once, as a bucketed table. A step's tables go as soon as they are read. ``docs`` should be a table or
another source that gives the same rows in the same order when a task runs again.

Null text counts as empty; rows that repeat, and rows of one doc_id, are texts of their own, so each is the other's copy
and loses what they share. Texts shorter than ``length`` keep everything. An empty table gives an empty result. Further
columns are ignored. A text is one cell and, with about 30 bytes of work space a byte in ``SEGMENT`` bytes at a time, may
be as long as a cell may be; runs of one character have an anchor at each byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_bytes, text_of

LENGTH = 400
#: Bytes at a start position whose hash decides which is an anchor, at most.
HEAD = 12
#: Start positions looked at together.
SEGMENT = 1 << 20
#: Rows of a batch that tasks send on.
BATCH = 1 << 16
#: Bytes of texts and lists that a worker is sent at a time, a single row apart.
BATCH_BYTES = 2 << 20
_K = tuple(np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xD6E8FEB86659FD93))


def shape(length: int) -> tuple[int, int, int]:
    """(start positions of a window, bytes of a q-gram, offsets of a block): four windows and a q-gram fit into ``length``."""
    window = max(1, length * 9 // 40)
    return window, length - 4 * window + 1, max(1, window // 10)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[2]
    h = (h ^ (h >> np.uint64(32))) * _K[2]
    return h ^ (h >> np.uint64(32))


def hashed(data: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at each place; ``data`` has eight bytes more than are asked for."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    if size < 8:
        return mix(words[at] & np.uint64((1 << (8 * size)) - 1))
    out = mix(words[at])
    for k in [*range(8, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = mix(out * _K[0] + (words[k:][at] if isinstance(at, slice) else words[at + k]))
    return out


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours of x."""
    k = 1
    while 2 * k <= w:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(place, place of the next or -1, offsets of the strings that belong to it, name of the q-gram) of each anchor.

    The offsets, least | greatest << 16, tell how far before the anchor its strings start; -1 if it has none.
    """
    window, gram, _ = shape(length)
    n, head = len(text), min(HEAD, gram)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    data = np.frombuffer(text + bytes(24), np.uint8)
    last = n - window - head + 1  # the last window's start
    parts = []
    for lo in range(0, last + 1, SEGMENT):
        hi = min(lo + SEGMENT, last + 1)
        stop = min(hi + window, last + 1)  # windows looked at, for the next anchors
        first = hashed(data[lo : stop + window + head + 24], slice(0, stop + window - 1 - lo), head)
        place = np.arange(len(first), dtype=np.uint64)
        least = _least(first >> np.uint64(24) << np.uint64(24) | place, window)  # the leftmost of equal ones
        of = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], of[1 : hi - lo] != of[: hi - lo - 1]]))
        own = of[begin]
        ends = np.append(begin[1:], hi - lo) - 1
        nxt = np.where(own + 1 < len(of), of[np.minimum(own + 1, len(of) - 1)] + lo, -1)
        parts.append((own + lo, nxt, begin + lo, ends + lo))
    at, nxt, begin, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.concatenate([[True], at[1:] != at[:-1]])  # an anchor may go on in the next segment
    ends = ends[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    at, nxt, begin = at[new], nxt[new], begin[new]
    ends = np.minimum(ends, n - length)
    span = np.where(ends >= begin, at - ends | at - begin << 16, -1)
    ok = at + gram <= n
    at, nxt, span = at[ok], nxt[ok], span[ok]
    return at, nxt, span, hashed(data, at, gram)


def refined(doc: np.ndarray, at: np.ndarray, nxt: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which suffixes have a later bucket, where that points in turn, their refined names). ``doc`` < 2**31 tells texts apart."""
    key = doc << 32 | at
    order = np.argsort(key)
    want = doc << 32 | np.maximum(nxt, 0)
    found = np.searchsorted(key, want, sorter=order)
    later = order[np.minimum(found, len(key) - 1)] if len(key) else found
    keep = np.flatnonzero((nxt >= 0) & (key[later] == want))
    later = later[keep]
    gap = (at[later] - at[keep]).astype(np.uint64)
    return keep, nxt[later], mix(mix(name[keep] * _K[0] + gap) * _K[1] + name[later])


def digests(parts: Iterator[bytes | memoryview]) -> np.ndarray:
    """128-bit digests as two columns of uint64."""
    one = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([one(p) for p in parts]), "<u8").reshape(-1, 2).copy()


def contexts(text: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, digest) of all that strings around each anchor reach; the anchor's place in it is part of the digest."""
    window, view = shape(length)[0], memoryview(text)
    lo, hi = np.maximum(at - window + 1, 0), np.minimum(at + length, len(text))
    d = digests(view[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True))
    d[:, 0] ^= mix((at - lo).astype(np.uint64) + np.uint64(1))
    return lo, hi, d


def blocks(text: bytes, at: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, its span, block, name of the shared bytes, whether the cover lies in the text, its digest) of each block that has strings."""
    step, n, view = shape(length)[2], len(text), memoryview(text)
    near, far = span & 0xFFFF, span >> 16
    count = far // step - near // step + 1
    which = np.repeat(np.arange(len(at)), count)
    block = near[which] // step + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    a, s = at[which], span[which]
    begin = a - block * step - (step - 1)  # of the cover; what is shared begins step - 1 later and ends as much earlier
    tag = mix(block.astype(np.uint64) + np.uint64(1))
    shared = digests(view[b + step - 1 : b + length] for b in begin.tolist())[:, 0] ^ tag
    inside = (begin >= 0) & (begin + step - 1 + length <= n)
    cover = digests(view[max(b, 0) : b + step - 1 + length] for b in begin.tolist())
    cover[:, 0] ^= tag
    return a, s, block, shared, inside, cover


def strings(text: bytes, at: np.ndarray, span: np.ndarray, block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, digest) of each string of the blocks that belongs to its anchor; the offset is part of the digest."""
    step, view = shape(length)[2], memoryview(text)
    lo, hi = np.maximum(span & 0xFFFF, block * step), np.minimum(span >> 16, block * step + step - 1)
    count = hi - lo + 1
    which = np.repeat(np.arange(len(at)), count)
    offset = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    start = at[which] - offset
    d = digests(view[s : s + length] for s in start.tolist())
    d[:, 0] ^= mix(offset.astype(np.uint64) + np.uint64(1))
    return start, d


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs as (bounds, flat columns)."""
    offset = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(int(offset[0]), int(offset[-1] - offset[0]))
    return offset - offset[0], {f.name: np.asarray(flat.field(k)) for k, f in enumerate(flat.type)}


_TYPES = {"long": pa.int64(), "int": pa.int32()}


def _sender(schema: str):
    """Collects tuples of NumPy columns; gives record batches of ``schema`` (longs and ints) when there are enough rows."""
    fields = [c.split() for c in schema.split(", ")]
    held: list[tuple] = []

    def send(columns: tuple | None) -> Iterator[pa.RecordBatch]:
        if columns is not None and len(columns[0]):
            held.append(columns)
        if held and (columns is None or sum(len(c[0]) for c in held) >= BATCH):
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)).cast(_TYPES[t]) for x, (_, t) in zip(whole, fields, strict=True)], [n for n, _ in fields])

    return send


SUFFIX = "row long, at int, nxt int, span int, name long"


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _sender(SUFFIX)
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                at, nxt, span, name = anchors(text, length)
                yield from send((np.full(len(at), row), at, nxt, span, name))
        yield from send(None)

    return rows.where(F.octet_length("text") >= length).select("row", "text").mapInArrow(run, SUFFIX)


def _refined(lists: DataFrame, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _sender(SUFFIX)
        for b in batches:
            bounds, c = _lists(b.column(1))
            doc = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            at, nxt = c["at"].astype(np.int64), c["nxt"].astype(np.int64)
            keep, beyond, name = refined(doc, at, nxt, c["name"].view(np.uint64))
            if last:  # what follows needs suffixes with strings of their own only
                ok = c["span"][keep] >= 0
                keep, beyond, name = keep[ok], beyond[ok], name[ok]
            yield from send((np.asarray(b.column(0))[doc[keep]], at[keep], beyond, c["span"][keep], name))
        yield from send(None)

    return lists.select("row", "s").mapInArrow(run, SUFFIX)


def _met_twice(df: DataFrame, scratch: Scratch, *key: str) -> DataFrame:
    """The rows whose key other rows have too. The keys are written first, so that the join's hot ones can be split."""
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    return df.join(scratch.save(twice, "_".join(["twice", *key, uuid.uuid4().hex])), [*key], "left_semi")


def _by_row(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("row").agg(F.collect_list(F.struct(*columns)).alias("s"))


def _on_texts(rows: DataFrame, lists: DataFrame, schema: str, of) -> DataFrame:
    """``of`` (row, text, flat columns of the row's list) for each row that has a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = _sender(schema)
        for b in batches:
            bounds, c = _lists(b.column(2))
            for k, (row, text) in enumerate(zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True)):
                own = slice(bounds[k], bounds[k + 1])
                yield from send(of(row, text, {name: x[own] for name, x in c.items()}))
        yield from send(None)

    return rows.join(lists, "row").select("row", "text", "s").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, doc_id, text, s): each row with the spans (lo, hi) that repeated strings cover, null where there are none."""
    if length < 8:
        raise ValueError("strings of 8 bytes at least")
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        return _spans(docs, length)


def _spans(docs: DataFrame, length: int) -> DataFrame:
    window, _, step = shape(length)
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = scratch.save_bucketed(rows, "rows", "row")

    # 1, 2: buckets by q-gram, refined twice.
    suffixes, name = scratch.save(_anchors(rows, length), "bucket0"), "bucket0"
    for k in (1, 2, 3):
        columns = ("at", "nxt", "span", "name") if k < 3 else ("at", "span", "name")
        lists = scratch.save(_by_row(_met_twice(suffixes, scratch, "name"), *columns), f"lists{k}")
        scratch.drop(name)
        if k < 3:
            suffixes, name = scratch.save(_refined(lists, k == 2), f"bucket{k}"), f"bucket{k}"
            scratch.drop(f"lists{k}")

    # 3: contexts.
    def around(row: int, text: bytes, c: dict) -> tuple:
        at = c["at"].astype(np.int64)
        lo, hi, d = contexts(text, at, length)
        return np.full(len(at), row), at, c["span"], c["name"], lo, hi, d[:, 0], d[:, 1]

    wide = scratch.save(_on_texts(rows, lists, "row long, at int, span int, name long, lo int, hi int, d1 long, d2 long", around), "contexts")
    scratch.drop("lists3")
    fine = wide.groupBy("name", "d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "span")).alias("first"))
    fine = scratch.save(fine, "fine")
    settled = wide.join(fine.where("n > 1").select("name", "d1", "d2"), ["name", "d1", "d2"], "left_semi").select("row", "lo", "hi")
    settled = scratch.save(settled, "settled")
    scratch.drop("contexts")
    open_ = fine.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("name")
    open_ = scratch.save(open_, "open")
    asked = scratch.save(_by_row(fine.join(open_, "name", "left_semi").select("first.*"), "at", "span"), "asked")
    scratch.drop("fine")

    # 3: blocks of offsets.
    def of_blocks(row: int, text: bytes, c: dict) -> tuple:
        a, s, block, shared, inside, cover = blocks(text, c["at"].astype(np.int64), c["span"].astype(np.int64), length)
        return np.full(len(a), row), a, s, block, shared, inside, cover[:, 0], cover[:, 1]

    told = scratch.save(_on_texts(rows, asked, "row long, at int, span int, block int, shared long, inside int, e1 long, e2 long", of_blocks), "blocks")
    scratch.drop("asked")
    live = scratch.save(_met_twice(told, scratch, "shared"), "live")
    scratch.drop("blocks")
    # Covers with how often each was met and one of its blocks; a cover that a text cuts off settles nothing.
    covers = live.where("inside = 1").groupBy("shared", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "span", "block")).alias("first"))
    covers = scratch.save(covers, "covers")
    begin = F.col("at") - F.col("block") * step - (step - 1)
    whole = live.where("inside = 1").join(covers.where("n > 1").select("shared", "e1", "e2"), ["shared", "e1", "e2"], "left_semi")
    whole = scratch.save(whole.select("row", begin.alias("lo"), (begin + step - 1 + length).alias("hi")), "whole")
    cut_off = live.where("inside = 0")
    unsettled = covers.where("n = 1").select("shared").unionByName(cut_off.select("shared")).distinct()
    unsettled = scratch.save(unsettled, "unsettled")
    asked = covers.join(unsettled, "shared", "left_semi").select("first.*").unionByName(cut_off.select("row", "at", "span", "block"))
    asked = scratch.save(_by_row(asked, "at", "span", "block"), "asked2")
    for name in ("live", "covers"):
        scratch.drop(name)

    # 3: strings one by one.
    def of_strings(row: int, text: bytes, c: dict) -> tuple:
        start, d = strings(text, *(c[k].astype(np.int64) for k in ("at", "span", "block")), length)
        return np.full(len(start), row), start, d[:, 0], d[:, 1]

    each = scratch.save(_on_texts(rows, asked, "row long, lo int, e1 long, e2 long", of_strings), "strings")
    scratch.drop("asked2")
    each = _met_twice(each, scratch, "e1", "e2").select("row", "lo", (F.col("lo") + length).alias("hi"))
    spans = scratch.save(_by_row(settled.unionByName(whole).unionByName(each), "lo", "hi"), "spans")
    for name in ("settled", "whole", "strings"):
        scratch.drop(name)
    return rows.join(spans, "row", "left").select("row", "doc_id", "text", "s")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, c = _lists(b.column(2))
            out: list[list] = [[] for _ in range(5)]
            for k, text in enumerate(_texts(b.column(1))):
                own = slice(bounds[k], bounds[k + 1])
                spans = merged(list(zip(c["lo"][own].tolist(), c["hi"][own].tolist(), strict=True)))
                ends = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True))
                for o, v in zip(out, (len(text), len(text) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    none = F.array().cast("array<struct<lo: int, hi: int>>")
    rows = repeated_spans(docs, length).select("doc_id", "text", F.coalesce("s", none).alias("s"))
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
