"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is two segments of 32 bits. Fingerprints that differ in 3 bits or fewer differ in at most one bit
of some segment, so each distinct fingerprint looks up, in a table for each segment, its own segment and those one bit
away (a Hamming ball of radius 1), and each match is checked by the distance of all 64 bits. Of two segments one bit
apart exactly one has a 0 there, so only bits that are 0 are flipped: half the ball finds every pair once.

Copies collapse into one fingerprint first. A table entry with more than ``hot`` fingerprints does not meet its probes
in pairs: there each fingerprint is joined to points near its other segment, with radius 1 and with radius 2 (two
fingerprints are 3 apart at most if some point is 1 from the one and 2 from the other), and everything around a point
that has a radius-1 member is linked to one of these. So the rows grow with the members, not with their square, and no
link between groups is lost. No join of these is broadcast, so the driver holds nothing that grows with the corpus.

A null text counts as empty. Texts without words have fingerprint zero and are linked like any other. Repeated rows and
ids are rows of their own; a null doc_id is ignored as a component's name unless its whole component has none. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_bytes, free_name, merged_with
from .components import components

SEED = 42
WORDS = 3
RADIUS = 3
#: Fingerprints under one segment value beyond which points take the place of pairs.
HOT = 512
#: Shingles of a sampled fingerprint.
SAMPLE = 3
#: Sketches under one segment value beyond which some of them are met first, and how many are.
CROWD, CENTRES = 8, 4
#: Sketches of a crowded entry that are compared with as many others in one go, and how many of these at a time.
TILE, STRIP = 512, 64
#: Bytes of tiles that a worker is sent at a time.
TILE_BYTES = 2 << 20
#: Hashes that are counted at a time, a bound of memory for long texts.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half the XXH64 hashes of the text's shingles; unsigned."""
    w = text.lower().split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else iter([tuple(w)])
    hashes = np.fromiter((digest(join(s), seed) for s in shingles), "<u8", max(1, len(w) - words + 1))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", words) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _differ(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _flip(value: Column, bit: Column) -> Column:
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))


def _bits() -> Column:
    return F.sequence(F.lit(0), F.lit(31))


def links(fps: DataFrame, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fps`` (fp) that connect all that are 3 bits apart or fewer."""
    scratch = scratch or Scratch(fps.sparkSession, "links")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = F.array(F.struct(F.lit(0).alias("seg"), low.alias("key"), high.alias("other")), F.struct(F.lit(1).alias("seg"), high.alias("key"), low.alias("other")))
    table = fps.select("fp", F.inline(halves))
    counts = scratch.save(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot")
    probe = F.concat(F.array(F.col("key")), F.transform(F.filter(_bits(), lambda j: F.getbit("key", j) == 0), lambda j: _flip(F.col("key"), j)))
    probes = table.select(F.col("seg").alias("pseg"), F.col("key").alias("own"), F.explode(probe).alias("pkey"), F.col("fp").alias("pfp"), F.col("other").alias("pother"))
    on = (F.col("seg") == F.col("pseg")) & (F.col("key") == F.col("pkey"))
    near = (_differ("fp", "pfp") <= RADIUS) & ((F.col("own") != F.col("key")) | (F.col("fp") < F.col("pfp")))
    if counts.isEmpty():
        return merged_with(table, probes, on & near).select(F.col("fp").alias("u"), F.col("pfp").alias("v"))
    h = counts.select(F.col("seg").alias("hseg"), F.col("key").alias("hkey"))
    cold = merged_with(table, h, (F.col("seg") == F.col("hseg")) & (F.col("key") == F.col("hkey")), "left_anti")
    pairs = merged_with(cold, probes, on & near).select(F.col("fp").alias("u"), F.col("pfp").alias("v"))
    # Hot entries: role 1 is at a point within one bit, role 2 within two. A probe from one bit off may be one bit off more.
    ball1 = lambda c: F.concat(F.array(c), F.transform(_bits(), lambda j: _flip(c, j)))
    two = F.flatten(F.transform(_bits(), lambda i: F.transform(F.filter(_bits(), lambda j: j > i), lambda j: _flip(_flip(F.col("pother"), i), j))))
    mine = merged_with(probes, h, (F.col("pseg") == F.col("hseg")) & (F.col("pkey") == F.col("hkey")), "left_semi")
    exact = mine.where("own = pkey")
    point = lambda df, role, at: df.select("pseg", "pkey", F.col("pfp").alias("fp"), F.lit(role).alias("role"), F.explode(at).alias("z"))
    one = point(exact, 1, ball1(F.col("pother")))
    around = one.unionByName(point(exact, 2, two)).unionByName(point(mine.where("own != pkey"), 3, ball1(F.col("pother"))))
    centre = one.groupBy("pseg", "pkey", "z").agg(F.min("fp").alias("c")).select(F.col("pseg").alias("s"), F.col("pkey").alias("k"), F.col("z").alias("cz"), "c")
    stars = merged_with(around, centre, (F.col("pseg") == F.col("s")) & (F.col("pkey") == F.col("k")) & (F.col("z") == F.col("cz"))).where("fp != c")
    return pairs.unionByName(stars.select(F.col("c").alias("u"), F.col("fp").alias("v"))).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id: the least doc_id reachable over links, its own included."""
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.save(fingerprints(docs, words), "fingerprints")
    groups = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = components(links(groups.select("fp"), hot, scratch), scratch).withColumnRenamed("node", "_fp")
    named = merged_with(groups, linked, groups["fp"] == linked["_fp"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(merged_with(named, least, "component").select(F.col("fp").alias("_fp"), "component_id"), "named")
    return merged_with(own, named, own["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The XXH64 hashes of a text's shingles, each once, in order."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else iter([tuple(w)])
    return np.unique(np.fromiter((digest(join(s), seed) for s in shingles), np.uint64, max(1, len(w) - words + 1)))


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    h = (hashes ^ np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` set each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _packed(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def sketch(text: bytes, words: int, lanes: int, samples: int = 0, seed: int = SEED) -> np.ndarray:
    """``lanes`` fingerprints of 64 bits of the *set* of a text's shingles, by different hashes, then ``samples`` fingerprints of
    a few shingles, those of the least hashes in a lane of their own; zeros without words.
    """
    first = shingle_set(text, words, seed)
    out = np.zeros(lanes + samples, np.uint64)
    if not len(first):
        return out
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(first), STEP):
            ones += _majority(_mixed(first[k : k + STEP], lane))
        out[lane] = _packed(2 * ones > len(first))
    for lane in range(lanes, lanes + samples):
        h = _mixed(first, lane)
        few = np.partition(h, SAMPLE - 1)[:SAMPLE] if len(h) > SAMPLE else h
        out[lane] = _packed(2 * _majority(few) > len(few))
    return out


def most_bits(similarity: float, bits: int) -> int:
    """Differing bits to expect of two sets of that Jaccard similarity and one size: their angle's share of the bits."""
    return int(np.ceil(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi))


def sketches(rows: DataFrame, words: int, lanes: int, samples: int = 0) -> DataFrame:
    """(row, f0, f1, ..., and sampled ones after the ``lanes`` first) of ``rows`` (row, text)."""
    wide = lanes + samples
    schema = ", ".join(["row long", *(f"f{k} long" for k in range(wide))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([sketch(t or b"", words, lanes, samples) for t in b.column(1).cast(pa.large_binary()).to_pylist()], np.uint64).reshape(-1, wide).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, k]) for k in range(wide))], ["row", *(f"f{k}" for k in range(wide))])

    return rows.mapInArrow(run, schema)


def alike(rows: DataFrame, pairs: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts in ``rows`` (row, text) have sets of shingles of that Jaccard similarity or more, told exactly."""
    ids = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t or b"", words).tobytes() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["row", "s"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    own = merged_with(rows, ids, rows["row"] == ids["u"], "left_semi").select("row", "text")
    with arrow_bytes(scratch.spark, TILE_BYTES):
        found = scratch.save(own.mapInArrow(sets, "row long, s binary"), "sets")
        one, two = (found.select(F.col("row").alias(k), F.col("s").alias(s)) for k, s in (("u", "x"), ("v", "y")))
        met = merged_with(merged_with(pairs, one, "u"), two, "v").select("u", "v", "x", "y")
        return scratch.save(met.mapInArrow(near, "u long, v long"), "alike")


def between(c: np.ndarray, f: np.ndarray, d: np.ndarray, g: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join the components ``c`` of sketches ``f`` and ``d`` of ``g`` as all pairs within ``most`` bits do."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for lo in range(0, len(c), STRIP):
        own = c[lo : lo + STRIP]
        apart = np.zeros((len(own), len(d)), np.uint16)
        for lane in range(f.shape[1]):
            apart += np.bitwise_count(f[lo : lo + STRIP, None, lane] ^ g[None, :, lane])
        i, j = np.nonzero((apart <= most) & (own[:, None] != d[None, :]))
        for u, v in np.unique(np.stack([own[i], d[j]], 1), axis=0).tolist():
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((u, v))
    return out


def _unsettled(probes: DataFrame, crowded: DataFrame, first: DataFrame, lanes: int, most: int, scratch: Scratch, tile: int) -> DataFrame | None:
    """(u, v): links between the components of ``first`` (gid, component, f0, f1, ...) that pairs in ``crowded`` entries make; None if there is nothing to compare.

    Entries of one component are settled. In each other one all its sketches meet all that look it up: both are dealt
    into tiles of about ``tile`` sketches by hash, and each pair of tiles is a row, compared in one go.
    """
    own, entry = [f"f{k}" for k in range(lanes)], ["seg", "key"]
    member = F.col("at") == F.col("key")

    def named(entries: DataFrame, *columns: str) -> DataFrame:  # a semi join sends the entries to the driver at most
        looked = probes.join(entries, entry, "left_semi").select(*entry, member.alias("member"), "by")
        return merged_with(looked, first.select(F.col("gid").alias("by"), "component", *columns), "by")

    parts = lambda n: F.ceil(n / F.lit(tile)).cast("int")
    sizes = named(crowded).groupBy(*entry).agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("p"), F.min("component").alias("a"), F.max("component").alias("z"))
    open_ = scratch.save(sizes.where("a != z").select(*entry, parts(F.col("m")).alias("gm"), parts(F.col("p")).alias("gp")), "open")
    if open_.isEmpty():
        return None
    place = F.when(F.col("member"), F.pmod(F.xxhash64("by"), F.col("gm"))).otherwise(F.col("gm") + F.pmod(F.xxhash64("by"), F.col("gp"))).cast("int")
    dealt = merged_with(named(open_, *own), open_, entry).select(*entry, "gm", (F.col("gm") + F.col("gp")).alias("g"), place.alias("tile"), F.struct("component", *own).alias("s"))
    tiles = scratch.save(dealt.groupBy(*entry, "gm", "g", "tile").agg(F.collect_list("s").alias("s")), "tiles")
    left = tiles.where("tile < gm").select(*entry, F.col("s").alias("a"), F.explode(F.sequence("tile", F.col("g") - 1)).alias("tile"))
    pairs = merged_with(left, tiles.select(*entry, "tile", F.col("s").alias("b")), [*entry, "tile"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(s: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            columns = [np.asarray(s.field(k)) for k in range(lanes + 1)]
            return columns[0], np.stack(columns[1:], 1).view(np.uint64)

        for b in batches:
            found = [x for a, z in zip(b.column(0), b.column(1), strict=True) for x in between(*split(a.values), *split(z.values), most)]
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    with arrow_bytes(scratch.spark, TILE_BYTES):
        return scratch.save(pairs.mapInArrow(run, "u long, v long"), "rest")


def similar(
    groups: DataFrame, lanes: int, most: int, scratch: Scratch, crowd: int = CROWD, centres: int = CENTRES, tile: int = TILE,
    samples: int = 0, sure: int = 0, wide: int = 0, exact: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(gid, component): what links between sketches ``groups`` (gid, f0, f1, ...) that differ in ``most`` bits or fewer of all connect.

    Multi-index hashing over 2 * ``lanes`` segments of 32 bits with balls of radius 1: every pair within 4 * lanes - 1
    bits is looked at, pairs further apart if one of their segments is near, or one of ``samples`` further fingerprints,
    which are segments that must be equal. Of an entry of over ``crowd`` sketches ``centres`` are met first, so rows grow
    with the members; what these leave in several components is then compared in full, in tiles, so an entry's size
    loses no link. With ``exact`` (pairs u, v to those that are links) it decides what differs in more than ``sure`` and
    at most ``wide`` bits; in tiles ``most`` decides.
    """
    own = [f"f{k}" for k in range(lanes)]
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(c, 32)
    halves = F.array(*(F.struct(F.lit(2 * k + j).alias("seg"), half(c).alias("key")) for k, c in enumerate(own) for j, half in enumerate((low, high))))
    if samples:
        halves = F.concat(halves, F.array(*(F.struct(F.lit(lanes + k).alias("seg"), F.col(f"f{k}").alias("key")) for k in range(lanes, lanes + samples))))
    table = scratch.save(groups.select("gid", *own, F.inline(halves)), "entries")
    crowded = scratch.save(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("seg", "key"), "crowded")
    probe = F.concat(F.array(F.col("key")), F.transform(F.filter(_bits(), lambda j: F.getbit("key", j) == 0), lambda j: _flip(F.col("key"), j)))
    if samples:
        probe = F.when(F.col("seg") < 2 * lanes, probe).otherwise(F.array("key"))
    probes = table.select(F.col("gid").alias("by"), "seg", F.col("key").alias("at"), F.explode(probe).alias("key"))
    cold = table.join(crowded, ["seg", "key"], "left_anti").withColumn("centre", F.lit(False))
    chosen = table.join(crowded, ["seg", "key"], "left_semi").groupBy("seg", "key", F.pmod(F.xxhash64("gid"), F.lit(centres))).agg(F.min(F.struct("gid", *own)).alias("c"))
    looked = scratch.save(cold.unionByName(chosen.select("seg", "key", "c.*").withColumn("centre", F.lit(True))), "looked")
    met = merged_with(looked, probes, ["seg", "key"]).where("if(centre, by != gid, at != key or by < gid)").select("by", "gid", "centre", *own)
    met = scratch.save(met, "met")
    others = groups.select(F.col("gid").alias("by"), *(F.col(c).alias(f"g{k}") for k, c in enumerate(own)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"g{k}"))) for k, c in enumerate(own)), F.lit(0))
    near = met.join(others, "by").withColumn("apart", apart).where(F.col("apart") <= (wide if exact else most))
    told = None
    if exact:
        near = scratch.save(near.select("by", "gid", "centre", "apart"), "near")
        asked = near.where(F.col("apart") > sure).select(F.greatest("by", "gid").alias("u"), F.least("by", "gid").alias("v")).distinct()
        told, near = exact(scratch.save(asked, "asked")), near.where(F.col("apart") <= sure)
    # Of the centres that a sketch is near to the least will do here: what this leaves apart is compared below.
    links = near.groupBy(F.col("by").alias("u"), "centre", F.when(~F.col("centre"), F.col("gid")).alias("pair")).agg(F.min("gid").alias("v")).select("u", "v")
    links = links if told is None else links.unionByName(told.select("u", "v"))
    linked = components(links, scratch).withColumnRenamed("node", "gid")
    first = scratch.save(groups.join(linked, "gid", "left").select("gid", F.coalesce("component", "gid").alias("component"), *own), "first")
    for name in ("looked", "met"):
        scratch.drop(name)
    rest = _unsettled(probes, crowded, first, lanes, most, scratch, tile)
    if rest is None:
        return first.select("gid", "component")
    more = components(rest, Scratch(scratch.spark, "rest", scratch.heaps)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return first.join(more, "component", "left").select("gid", F.coalesce("whole", "component").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4, crowd: int = CROWD, samples: int = 8) -> DataFrame:
    """The rows of ``docs``, all columns, that are left when one row of each group of near duplicates stays.

    Near are texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more; a group is a
    component of such links. Candidates are pairs with a segment of their 64 * ``lanes`` bits within one bit, or with one
    of ``samples`` fingerprints of three shingles in common. They are links when they differ in no more bits than a
    similarity half way to 1 makes one expect; up to four deviations more than one of ``similarity`` does, their sets of
    shingles are compared. The least doc_id stays (null last), then the first row.
    Texts without words are near each other. Rows are numbered once, in a written table, and go by number, so neither
    null nor repeated ids merge texts. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "kept", heaps=True)  # many short rounds: sorts leave more garbage than the rows need
    row, own = free_name(docs, "row"), [f"f{k}" for k in range(lanes + samples)]
    rows = scratch.save_bucketed(docs.withColumn(row, F.monotonically_increasing_id()), "rows", row)
    marked = scratch.save(sketches(rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text")), words, lanes, samples), "sketches")
    groups = scratch.save(marked.groupBy(*own).agg(F.min("row").alias("gid")), "groups")
    work = Scratch(docs.sparkSession, "links", heaps=True)
    texts = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    exact = lambda pairs: alike(texts, pairs, words, similarity, work)
    bits = 64 * lanes
    most = most_bits(similarity, bits)
    linked = similar(groups, lanes, most, work, crowd, samples=samples, sure=most_bits((1 + similarity) / 2, bits), wide=most + int(4 * np.sqrt(most * (1 - most / bits))), exact=exact)
    named = scratch.save(groups.join(linked, "gid").select(*own, "component"), "named")
    work.drop("")
    members = marked.join(named, own).select(F.col("row").alias(row), "component")
    places = rows.select(row, F.col("doc_id").alias("id")).join(members, row)
    first = places.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("k"))
    kept = scratch.save(first.select(F.col("k")[row].alias(row)), "kept")
    for name in ("sketches", "groups", "named"):
        scratch.drop(name)
    return rows.join(kept, row, "left_semi").select(docs.columns)
