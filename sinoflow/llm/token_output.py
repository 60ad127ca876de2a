"""Token ids as fixed-width packed blocks.

The format. A corpus is two Parquet folders, ``blocks`` and ``shards``; Parquet and Spark's committer carry the bytes, so
any store that Spark writes will do and a retried task leaves no second copy. A row of ``blocks`` is one block of whole
documents in ascending doc_id order:

    shard int, block long     the shard is a range of doc_ids, blocks count from 0 within it
    first long                ids in the shard before this block
    payload binary            magic b"TPK1" | u32 bits | u64 n_docs | u64 n_ids | i64 doc_id[n_docs]
                              | u64 offset[n_docs + 1] | packed ids; integers are little-endian

Ids are ``bits`` = bit_length(vocabulary size - 1) wide, little-endian bit order, back to back. Any range unpacks with one
numpy.unpackbits, and offset[k]..offset[k + 1] finds document k without touching the rest. A row of ``shards`` has a
shard's number of ids and the ids before it.

A document of any length is one block at least. Null text counts as empty and has the end id alone; rows that repeat a
doc_id keep a place each, in the order of their texts' hashes. A null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_bytes, kept, partitions, text_of

MAGIC = b"TPK1"
#: Ids after which a block is closed; a longer document has a block to itself.
BLOCK_IDS = 1 << 16
#: Pieces of text whose ids a worker remembers.
KNOWN_PIECES = 500_000
#: Bytes of texts that a worker is sent at a time, a single text apart.
BATCH_BYTES = 8 << 20
NULL_ID = -(2**63)


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of packed ``data``, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    lo = start * bits
    part = np.frombuffer(data, np.uint8)[lo // 8 : -(-stop * bits // 8)]
    flat = np.unpackbits(part, bitorder="little")[lo % 8 : lo % 8 + (stop - start) * bits].reshape(-1, bits)
    full = np.zeros((len(flat), 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    head = struct.pack("<4sIQQ", MAGIC, bits, len(doc_ids), len(ids))
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()
    return head + names + offsets + pack(ids, bits)


class Block:
    """Random access to one block: ``doc_ids``, ``offsets``, ``ids(k)`` of document k, ``all()``."""

    def __init__(self, payload: bytes) -> None:
        magic, self.bits, n, self.n_ids = struct.unpack_from("<4sIQQ", payload)
        if magic != MAGIC:
            raise ValueError("not a block of packed ids")
        at = struct.calcsize("<4sIQQ")
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 8 * n).astype(np.int64)
        self.data = memoryview(payload)[at + 16 * n + 8 :]

    def ids(self, k: int) -> np.ndarray:
        return unpack(self.data, self.bits, int(self.offsets[k]), int(self.offsets[k + 1]))

    def all(self) -> np.ndarray:
        return unpack(self.data, self.bits, 0, self.n_ids)


class Pieces:
    """Ids of pieces met lately, by their bytes: two generations, so the memory is bounded and what recurs stays."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = max(1, most // 2), {}, {}
        self.room(0)

    def room(self, n: int) -> None:
        self.start, self.length, self.ids, self.n, self.used = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(4 * n, np.uint32), 0, 0

    def places(self, pieces: list[bytes], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each piece's place in ``start`` and ``length``; ``encode`` gives the ids and their number for those not known."""
        if len(self.young) >= self.most:
            self._age()
        get, old = self.young.get, self.old.get
        at = np.array([-1 if (k := get(p)) is None else k for p in pieces], np.int64)
        miss = np.flatnonzero(at < 0)
        if len(miss) and self.old:
            back = [(int(i), k) for i in miss if (k := old(pieces[i])) is not None]
            for i, k in back:
                at[i] = self.young[pieces[i]] = k
            miss = miss[at[miss] < 0]
        if len(miss):
            new = [pieces[i] for i in miss]
            at[miss] = self._add(*encode(new))
            self.young.update(zip(new, at[miss].tolist(), strict=True))
        return at

    def _add(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        n, used = self.n + len(length), self.used + len(ids)
        if n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.start, self.length))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(used, np.uint32)])
        self.ids[self.used : used], self.length[self.n : n] = ids, length
        self.start[self.n : n] = self.used + np.cumsum(length) - length
        at = np.arange(self.n, n)
        self.n, self.used = n, used
        return at

    def _age(self) -> None:
        """The young become the old; what only the former old had goes."""
        keep = np.fromiter(self.young.values(), np.int64, len(self.young))
        names, length, ids = list(self.young), self.length[keep], gather(self.ids, self.start[keep], self.length[keep])
        self.room(0)
        self.old, self.young = dict(zip(names, self._add(ids, length).tolist(), strict=True)), {}


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[k] : start[k] + length[k]] of all k, one after the other."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


class ByteLevel:
    """An encoder of whole texts for byte-level BPE with the usual pre-tokenization, which cuts and remembers pieces.

    A cut is made only where a pre-token ends whatever stands before it, so the ids of the pieces are the text's:
    between letters, digits and other signs (not after an apostrophe, which may begin a contraction), before white
    space that follows something else, before the last character of a run of white space, and after white space that
    is not a space. What the classes of a character are is known for ASCII and for ``TRUSTED`` ranges; nothing is cut
    beside other characters but before a space. A piece of known classes without an apostrophe is one pre-token, and
    the library's BPE model takes many of them in one string, parted by blanks, in which a byte is its usual letter;
    their ends are found from the ids' lengths. Other pieces go through the whole library one by one, as do texts with
    a special token or unusual white space.
    """

    #: Bytes of text that are cut at a time, a bound of memory; longer texts are cut between two words.
    CHUNK = 2 << 20
    LETTER, DIGIT, SIGN, SPACE, UNKNOWN = 1, 2, 4, 8, 16
    #: Character ranges whose general category is old and settled.
    TRUSTED = ((0xA1, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481), (0x48A, 0x513), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A))

    def __init__(self, tokenizer, special: list[str], most: int) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        self.inner = Tokenizer(tokenizer.model)
        self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self.special = [s.encode() for s in special]
        self.blank = np.zeros(256, bool)  # bytes that unusual white space may begin with
        self.blank[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self.known = Pieces(most)
        shown = [k for k in range(256) if 33 <= k <= 126 or (k >= 161 and k != 173)]
        self.letter = np.arange(256, dtype="<u4")  # a byte's letter: itself where that can be printed, else one from 256 on
        self.letter[[k for k in range(256) if k not in set(shown)]] = 256 + np.arange(256 - len(shown))
        self.one = np.array([self._class(chr(k)) if k < 128 else self.UNKNOWN for k in range(256)], np.uint8)
        self.two = np.full(1 << 16, self.UNKNOWN, np.uint8)
        for lo, hi in self.TRUSTED:
            for k in range(lo, hi + 1):
                self.two[int.from_bytes(chr(k).encode(), "big")] = self._class(chr(k))

    def _class(self, c: str) -> int:
        import unicodedata

        if c in " \t\n\r\v\f":
            return self.SPACE
        return {"L": self.LETTER, "N": self.DIGIT}.get(unicodedata.category(c)[0], self.SIGN)

    def odd(self, data: np.ndarray, raw: bytes | memoryview) -> Iterator[int]:
        """Places of special tokens and of unusual white space."""
        for s in self.special:
            yield from (m.start() for m in re.finditer(re.escape(s), raw))
        at = np.flatnonzero(self.blank[data])
        a, b, c = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
        third = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        found = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & third | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        yield from at[found].tolist()

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where pieces start, and the end; whether each is one pre-token for certain). Texts begin at ``starts``."""
        kind = self.one[data]
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
        kind[lead] = kind[lead + 1] = self.two[data[lead].astype(np.int64) << 8 | data[lead + 1]]
        before, after, space = kind[:-1], kind[1:], kind == self.SPACE
        first = np.zeros(len(data) + 1, bool)
        first[starts] = first[-1] = True
        cut = (before != after) & ((before | after) < self.SPACE) & ~((data[:-1] == 39) & (after == self.LETTER))
        cut |= space[1:] & ~space[:-1]
        cut |= space[:-1] & ~space[1:] & (data[:-1] != 32)
        last = np.zeros(len(data), bool)  # white space before something else in the same text
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
        cut |= space[:-1] & last[1:]
        first[1:-1] |= cut
        at = np.flatnonzero(first)
        unsure = np.concatenate([[0], np.cumsum((kind == self.UNKNOWN) | (data == 39))])
        return at, unsure[at[1:]] == unsure[at[:-1]]

    def _new(self, pieces: list[bytes], sure: dict[bytes, bool]) -> tuple[np.ndarray, np.ndarray]:
        plain = [p for p in pieces if sure[p]]
        size = np.array([len(p) for p in plain], np.int64)
        joined = self.letter[np.frombuffer(b"".join(plain), np.uint8)]
        joined = np.insert(joined, np.cumsum(size)[:-1], 32) if plain else joined
        got = [np.array(e.ids, np.uint32) for e in self.inner.encode_batch_fast([joined.tobytes().decode("utf-32-le")], add_special_tokens=False)]
        ids = np.concatenate(got)
        read, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(size)
        stop = np.searchsorted(read, ends) + 1
        if len(plain) and (read[-1] != ends[-1] or not np.array_equal(read[stop - 1], ends)):
            raise ValueError("the tokenizer's vocabulary lacks a byte")
        rest = dict(zip(other := [p for p in pieces if not sure[p]], self.whole([p.decode() for p in other]), strict=True))
        length = np.empty(len(pieces), np.int64)
        is_plain = np.fromiter((sure[p] for p in pieces), bool, len(pieces))
        length[is_plain], length[~is_plain] = np.diff(stop, prepend=0), [len(x) for x in rest.values()]
        every = np.concatenate([ids, np.array([k for x in rest.values() for k in x], np.uint32)])
        start = np.empty(len(pieces), np.int64)
        for own, base in ((is_plain, 0), (~is_plain, len(ids))):
            start[own] = base + np.cumsum(length[own]) - length[own]
        return gather(every, start, length), length

    def _chunk(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each of ``starts``)."""
        at, sure = self.cuts(data, starts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        of, names = np.asarray(pieces.indices), pieces.dictionary.to_pylist()
        first = np.zeros(len(names), bool)
        first[of] = sure  # the same piece is sure everywhere
        place = self.known.places(names, lambda new, known=dict(zip(names, first.tolist(), strict=True)): self._new(new, known))[of]
        length = self.known.length[place]
        before = np.concatenate([[0], np.cumsum(length)])
        return gather(self.known.ids, self.known.start[place], length), before[np.searchsorted(at, starts)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
        k, lo, end = 0, int(offset[0]), int(offset[-1])
        while lo < end:
            k = int(np.searchsorted(offset, lo, "right")) - 1  # the text that lo lies in
            stop = int(np.searchsorted(offset, lo + self.CHUNK, "right")) - 1
            hi = int(offset[stop])
            if hi <= lo:  # one long text: up to a blank between two words, or its end
                stop, hi = k + 1, int(offset[k + 1])
                found = re.compile(rb"[A-Za-z] [A-Za-z]").search(data, lo + self.CHUNK, hi)
                hi = found.start() + 1 if found else hi
            bounds = np.clip(offset[k : stop + 1], lo, hi) - lo
            ids, before = self._chunk(data[lo:hi], bounds[:-1])
            for j, (a, z) in enumerate(zip(before, [*before[1:], len(ids)], strict=True)):
                if z > a:
                    out[k + j].append(ids[a:z])
            lo = hi
        none = np.zeros(0, np.uint32)
        got = [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out]
        own = data[offset[0] : end]
        odd = sorted({int(np.searchsorted(offset, offset[0] + m, "right")) - 1 for m in self.odd(own, memoryview(own))})
        for j, ids in zip(odd, self.whole([texts[j].as_py() for j in odd]), strict=True):
            got[j] = np.array(ids, np.uint32)
        return got


def tokenizer_of(definition: str, most: int = KNOWN_PIECES) -> tuple[Callable[[pa.Array], list[np.ndarray]], int]:
    """An encoder of texts from a tokenizer's JSON, and its vocabulary size."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, spec = Tokenizer.from_str(definition), json.loads(definition)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        return ByteLevel(tokenizer, [t["content"] for t in added], most), size
    return (lambda texts: [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]), size


BLOCKS = "shard int, block long, first long, n_ids long, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, block_ids: int = BLOCK_IDS, pieces: int = KNOWN_PIECES) -> None:
    """Encodes ``docs`` with the tokenizer file (read on the driver) and writes the packed corpus to ``path``; a worker remembers about ``pieces``."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder, vocabulary = kept(("tokenizer", pieces, definition.value), lambda: tokenizer_of(definition.value, pieces))  # a worker's later tasks go on with its pieces
        bits, end = width(max(vocabulary, end_id + 1)), np.array([end_id], np.uint32)
        names, ids, held, first, k = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, ids, held, first, k
            payload = write_block(names, [len(x) for x in ids], np.concatenate(ids), bits)
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([k], pa.int64()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([payload], pa.binary())})
            names, ids, first, held, k = [], [], first + held, 0, k + 1
            return row

        for b in batches:
            who = b.column(0).to_pylist()
            for lo in range(0, len(who), 2000):
                for d, x in zip(who[lo : lo + 2000], encoder(b.column(1)[lo : lo + 2000]), strict=True):
                    if held and held + len(x) + 1 > block_ids:
                        yield close()
                    names.append(d)
                    ids.append(np.concatenate([x, end]))
                    held += len(x) + 1
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ("doc_id", F.xxhash64("text"))  # rows of one id, null among them, are dealt out by their texts
    ordered = ordered.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    with arrow_bytes(spark, BATCH_BYTES):
        ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    shards = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    shards.select("shard", "n_ids", before.alias("before")).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start (ids of all documents before it), ids array<long>."""
    return _read(spark, path, "ids array<bigint>", lambda x: (pa.array(x, pa.list_(pa.int64())),), lambda ids: ids.tolist())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_tokens, but n_tokens and ids_crc32 (over little-endian unsigned 32-bit ids) in the ids' place."""
    return _read(spark, path, "n_tokens long, ids_crc32 long", lambda x: (pa.array([a for a, _ in x], pa.int64()), pa.array([b for _, b in x], pa.int64())), lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())))


def _read(spark: SparkSession, path: str, columns: str, arrays, of) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", *(c.split()[0] for c in columns.split(", "))]
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = Block(payload)
                every, offsets = block.all(), block.offsets
                got = [of(every[offsets[k] : offsets[k + 1]]) for k in range(len(block.doc_ids))]
                who = pa.array([None if d == NULL_ID else d for d in block.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([who, pa.array(start + offsets[:-1], pa.int64()), *arrays(got)], names)

    blocks, shards = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema("shard int, n_ids long, before long").parquet(f"{path}/shards")
    return blocks.join(shards.select("shard", "before"), "shard").select((F.col("before") + F.col("first")).alias("start"), "payload").mapInArrow(decode, f"doc_id long, start long, {columns}")


def encode_corpus(docs: DataFrame, tokenizer: str, end_id: int = 0, pieces: int = KNOWN_PIECES) -> DataFrame:
    """Writes ``docs`` to the shared folder, reads the files back and returns doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = Scratch(spark, "tokens").path("corpus")
    write_tokens(docs, tokenizer, path, end_id, pieces=pieces)
    return read_digests(spark, path)
