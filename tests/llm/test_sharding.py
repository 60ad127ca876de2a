"""Shards against a plain minimax partition, and on odd inputs."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from sinoflow.llm import common, queries, sharding


def groups_of(rows):
    """[(size, first, text)] in the operator's order, of (doc_id, text)."""
    import hashlib

    by = defaultdict(list)
    for d, t in rows:
        by[(t or "").encode()].append(d)
    first = lambda ids: (0, 0) if None in ids and all(x is None for x in ids) else (1, min(x for x in ids if x is not None))
    out = [((len(t) + 16) * len(ids), first(ids), hashlib.sha256(t).digest(), t) for t, ids in by.items()]
    return sorted(out, key=lambda g: (g[1], g[2]))


def smallest(sizes, shards):
    """The least capacity of a contiguous partition, by dynamic programming over all cuts."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] + [float("inf")] * len(sizes)
        for j in range(1, len(sizes) + 1):
            load = 0
            for i in range(j, 0, -1):
                load += sizes[i - 1]
                new[j] = min(new[j], max(load, best[i - 1]))
        best = new
    return best[-1]


def check(rows, got, shards):
    sizes = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, sizes(t), zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())
    # Giants first, then the least capacity for what is left, shard by shard.
    groups, loads, left = groups_of(rows), [], shards
    whole = sum(g[0] for g in groups)
    for g in sorted(groups, key=lambda g: (-g[0], g[2])):
        if left == 1 or g[0] * left < whole:
            break
        loads, left, whole = [*loads, g[0]], left - 1, whole - g[0]
        groups.remove(g)
    rest = [g[0] for g in groups]
    while left and rest:
        load, most = 0, smallest(rest, left)
        while rest and load + rest[0] <= most:
            load += rest.pop(0)
        loads, left = [*loads, load], left - 1
    loads += [0] * (shards - len(loads))
    mine = Counter()
    for r in got:
        mine[r["shard"]] += r["size"]
    return [mine[k] for k in range(shards)], loads


@pytest.mark.parametrize(("seed", "grid"), [(1, 20_000), (2, 8), (3, 2)])
def test_as_plain_partition(spark, seed, grid):
    r = random.Random(seed)
    rows = [(k, "x" * r.choice([0, 3, 10, 40, 300]) + str(r.randint(0, 60))) for k in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shards in {1: (1, 7), 2: (4,), 3: (7,)}[seed]:
        got = sharding.assign(df, shards, grid=grid).collect()
        mine, plain = check(rows, got, shards)
        if shards == 1 or grid == 20_000:
            assert mine == plain
        assert max(mine) == max(plain)


def test_odd_inputs(spark, tmp_path):
    hot = "the same text " * 50
    rows = [(k, hot) for k in range(60)] + [(None, hot), (None, None), (None, ""), (5, "é"), (5, "é"), (7, "long " * 40_000)] + [(100 + k, f"text {k}") for k in range(60)]
    df = spark.createDataFrame([(d, t, "own", "own", "own", "own") for d, t in rows], "doc_id long, text string, row string, shard string, slot string, size string")
    got = sharding.assign(df, 5).collect()
    mine, plain = check(rows, got, 5)
    assert mine == plain and mine[0] == 200_016 and mine[1] == 61 * (len(hot) + 16)
    assert sorted(tuple(r) for r in sharding.assign(df, 5).collect()) == sorted(tuple(r) for r in got)
    assert sharding.assign(df.limit(0), 5).count() == 0
    few = sharding.assign(df.where("text = 'é'"), 5).collect()
    assert {r["shard"] for r in few} == {0} and sorted(r["slot"] for r in few) == [0, 1]
    path = common.Scratch(spark, "test").path("shards")
    sharding.write_shards(df, path, 5)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in back.collect()) == Counter((d, t, "own") for d, t in rows)
    assert set(back.columns) == {*df.columns, "shard_", "slot_"}


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").collect()]
    got = queries.op11_shards(spark, small).collect()
    mine, plain = check(rows, got, 40)
    assert mine == plain and min(mine) > 0
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
