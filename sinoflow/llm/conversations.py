"""Repair of conversations: error-correcting Earley parsing of their roles.

A sound conversation is empty or an optional system row and then pairs of a user and an assistant row. The grammar is
weighted: a row may be kept, deleted, given another role, and a row may be inserted; blank and repeated rows must go,
rows that break off cost more where they stay. Chart items keep the least (cost, audit); the completed chart's audit is
the repair: a letter an edit in order, ties to the least string.

Rows are put in one order over all conversations (conv_id, turn, digest of role and text) by range partitioning and
numbered; from there on only numbers and a hex digit a row (initial of the role, fault) travel. Runs of at most 2**10
rows of one conversation are parsed as tasks of their own, so a conversation of a third of all rows is parsed by many: a
run that may continue a conversation is parsed from each of the grammar's four states, and a fold over a conversation's
runs, in order, keeps the best way to each state. What a fold holds grows with the conversation as its audit does, which is
one cell. The last pass sends each text once, to its conversation, and streams it there in order: a digest over a whole
conversation has no parts.

Nulls: a null role or text is one space (so a null text is blank), null turns come first, a null conv_id is a
conversation. Rows of one turn stand in order of their digest. Repeated rows are duplicates. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged_with, partitions

WHITE = " \t\n\x0b\f\r"
INITIALS, NAMES = "sua", {"u": "user", "a": "assistant"}
#: Faults of a row, as the last two bits of its digit.
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
#: Costs of edits, and what a row that breaks off adds where it stays.
REROLE, DELETE, INSERT, BREAK = 1, 2, 5, 5
#: Rows of a run, as bits of its rows' numbers.
RUN_BITS = 10

#: What has been read so far, as nonterminals, with their productions. Deletions follow what they come after.
STATES = ("Nothing", "System", "User", "Assistant")
RULES = (
    ("Nothing", ("Nothing", "gone")),
    ("System", ("Nothing", "system")), ("System", ("System", "gone")),
    ("User", ("Nothing", "user")), ("User", ("System", "user")), ("User", ("Assistant", "user")), ("User", ("User", "gone")),
    ("Assistant", ("User", "assistant")), ("Assistant", ("Assistant", "gone")),
)
#: Rows that must be inserted for a conversation to end in a state.
MISSING = {"Nothing": 0, "System": 2, "User": 1, "Assistant": 0}


def edit(terminal: str, digit: int) -> tuple[int, str] | None:
    """(cost, letter) of reading a row as ``terminal``; None where it can't be."""
    initial, fault = divmod(digit, 4)
    if terminal == "gone":
        return DELETE, "D"
    if fault >= DUPLICATE:
        return None
    more = BREAK if fault == TRUNCATED else 0
    if INITIALS[initial : initial + 1] == terminal[0]:
        return more, "K"
    return None if terminal == "system" else (REROLE + more, "R")


READ = {t: [edit(t, d) for d in range(16)] for t in ("gone", "system", "user", "assistant")}


def parse(rows: str, start: str = "Nothing") -> dict[str, tuple[int, str]]:
    """The least (cost, audit) with which ``rows`` (hex digits) lead from ``start`` to each state, before insertions at the end.

    An Earley chart: items (production, dot, origin) with their least (cost, audit). A terminal is read from the next row,
    at the cost of its edit, or, a user or an assistant, inserted without one.
    """
    rules = (*RULES, (start, ()))
    chart: list[dict[tuple[int, int, int], tuple[int, str]]] = [{(k, 0, 0): (0, "") for k in range(len(rules))}]
    for i in range(len(rows) + 1):
        now, digit = chart[i], int(rows[i], 16) if i < len(rows) else None
        after: dict[tuple[int, int, int], tuple[int, str]] = {}
        if digit is None:
            done = sorted(((v, rules[k][0]) for (k, dot, _), v in now.items() if dot == len(rules[k][1])), reverse=True)
            return {head: v for v, head in done}
        agenda = list(now)
        while agenda:
            item = agenda.pop()
            (rule, dot, origin), (cost, audit) = item, now[item]
            head, body = rules[rule]
            grown: list[tuple[tuple[int, int, int], tuple[int, str]]] = []
            if dot == len(body):  # complete: those that waited for the head where this began
                waits = [(w, v) for w, v in chart[origin].items() if w[1] < len(rules[w[0]][1]) and rules[w[0]][1][w[1]] == head]
                grown = [((k, d + 1, o), (c + cost, a + audit)) for (k, d, o), (c, a) in waits]
            elif body[dot] in READ:  # scan, and insert
                how = READ[body[dot]][digit]
                if how:
                    key, value = (rule, dot + 1, origin), (cost + how[0], audit + how[1])
                    if key not in after or value < after[key]:
                        after[key] = value
                if body[dot] in ("user", "assistant"):
                    grown = [((rule, dot + 1, origin), (cost + INSERT, audit + "I"))]
            for key, value in grown:
                if key not in now or value < now[key]:
                    now[key] = value
                    agenda.append(key)
        if i:
            chart[i] = {}  # all origins are 0: productions begin with their nonterminal
        chart.append(after)
    raise AssertionError


def best(runs: list[dict[str, dict[str, tuple[int, str]]]]) -> tuple[int, str]:
    """The least (cost, audit) of a conversation whose runs lead from states to states as told.

    Two audits that have read the same rows and end with one are never the beginning of each other, so of equal costs
    the order of the parts decides.
    """
    at: dict[str, tuple[int, int, tuple]] = {"Nothing": (0, 0, ())}  # cost, rank of the audit, the audit's parts linked backwards
    for run in runs:
        reached: dict[str, tuple[tuple[int, int, str], tuple]] = {}
        for a, (cost, rank, parts) in at.items():
            for b, (more, audit) in run[a].items():
                key = (cost + more, rank, audit)
                if b not in reached or key < reached[b][0]:
                    reached[b] = (key, (parts, audit))
        order = {k: i for i, k in enumerate(sorted({key[1:] for key, _ in reached.values()}))}
        at = {b: (key[0], order[key[1:]], parts) for b, (key, parts) in reached.items()}
    cost, _, state = min((c + INSERT * MISSING[s], rank, s) for s, (c, rank, _) in at.items())
    parts, out = at[state][2], ["I" * MISSING[state]]
    while parts:
        parts, audit = parts
        out.append(audit)
    return cost, "".join(reversed(out))


def illegal(rows: str) -> int:
    """Neighbours whose initials are none of su, ua, au."""
    initials = [int(d, 16) // 4 for d in rows]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the repaired rows, as ``rows`` (role, text) stream by."""
    due = "u"
    for letter in audit:
        if letter == "I":
            role, text = NAMES[due], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = NAMES[due]
        due = "a" if role[:1] == "u" else "u"
        yield letter, role, text


def damage(conversations: DataFrame, one_in: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults where crc32(``conv_id:turn``) % ``one_in`` is 0 to 4: the row is dropped,
    emptied, loses its full stops, is repeated, or becomes the user's. Nulls count as one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % one_in
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.where("h > 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_times")).drop("_times")


def told(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest), without nulls in role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(both, 256)).alias("digest"))


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, initial, blank, broken, digest, place): ``place`` tells the order of all rows; its high bits are a partition's."""
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    light = told(rows).select("conv_id", "turn", initial.alias("initial"), (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken"), "digest", F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    dealt = light.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    return scratch.save(dealt.drop("row").withColumn("place", F.monotonically_increasing_id()), "numbered")


def faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, initial, fault). The first of equal rows is found by partial aggregation and told by its number, which is unique."""
    first = rows.groupBy("conv_id", "digest").agg(F.min("place").alias("_p")).select("_p")
    met = merged_with(rows, first, rows["place"] == first["_p"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("_p").isNull(), DUPLICATE).when(F.col("broken"), TRUNCATED).otherwise(FINE)
    return met.select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def counts(rows: DataFrame, every: DataFrame) -> DataFrame:
    """A row a conversation of ``every``: gaps, blank, duplicate, truncated; all 0 for one without rows."""
    flags = [F.sum((F.col("fault") == f).cast("long")).alias(name) for f, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    none = every.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(-1).alias("fault"))
    by_turn = rows.select("conv_id", "turn", "fault").unionByName(none).groupBy("conv_id", "turn").agg(*flags)
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  turns may lie further apart than a long reaches
    gaps = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn")), F.lit(0))
    return by_turn.groupBy("conv_id").agg(gaps.try_cast("long").alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of conversations that have rows (of ``faulty``)."""
    digit = F.substring(F.lit("0123456789abcdef"), F.col("initial") * 4 + F.col("fault") + 1, F.lit(1))
    runs = rows.groupBy("conv_id", F.shiftright("place", RUN_BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", digit.alias("d")))).alias("r"))
    runs = runs.select("conv_id", "run", F.array_join(F.transform("r", lambda x: x["d"]), "").alias("rows"), (F.col("r")[0]["place"] % (1 << RUN_BITS) == 0).alias("later"))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run, and of each start that it may have, the least costs and audits."""
        for b in batches:
            cost, audit = [], []
            for rows, later in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = [parse(rows, s) if later or not k else {} for k, s in enumerate(STATES)]
                cost.append([f[s][0] if s in f else None for f in found for s in STATES])
                audit.append([f[s][1] if s in f else None for f in found for s in STATES])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cost, pa.list_(pa.int64())), pa.array(audit, pa.list_(pa.string()))], ["conv_id", "run", "rows", "cost", "audit"])

    parsed = runs.mapInArrow(ways, "conv_id long, run long, rows string, cost array<long>, audit array<string>")
    whole = parsed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "rows", "cost", "audit"))).alias("runs"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs in b.column(1).to_pylist():
                table = [{a: {s: (r["cost"][4 * i + j], r["audit"][4 * i + j]) for j, s in enumerate(STATES) if r["cost"][4 * i + j] is not None} for i, a in enumerate(STATES)} for r in runs]
                out.append((illegal("".join(r["rows"] for r in runs)), *best(table)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["conv_id", "illegal", "cost", "audit"])

    return whole.mapInArrow(fold, "conv_id long, illegal long, cost long, audit string")


def streamed(rows: DataFrame, audits_: DataFrame, schema: str, emit: Callable[[object, str, Iterator[tuple[str, str, str]]], Iterator[tuple]]) -> DataFrame:
    """``emit`` of each conversation's (conv_id, audit, repaired rows), the rows streaming by in order."""
    texts = told(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = audits_.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest"), F.coalesce("audit", F.lit("")).alias("audit"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), F.col("digest")]
    met = texts.unionByName(heads).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        own = ((role, text) for _, _, role, text in every)
        held: list[tuple] = []
        for conv, audit, _, _ in every:  # a head; its rows are read by what follows
            for out in emit(conv, audit, replay(audit, own)):
                held.append(out)
                if len(held) == 1000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], kinds)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in held], kinds)

    of = {"long": pa.int64(), "string": pa.string()}
    kinds = pa.schema([(c.split()[0], of[c.split()[1]]) for c in schema.split(", ")])
    return met.mapInArrow(run, schema)


def _rows(conv, audit: str, repaired: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
    for k, (letter, role, text) in enumerate(repaired):
        yield conv, k, letter, role, text


def _digest(conv, audit: str, repaired: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
    digest = hashlib.sha256()
    for k, (_, role, text) in enumerate(repaired):
        digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    yield conv, audit, digest.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role, text."""
    scratch = Scratch(rows.sparkSession, "conversations")
    found = scratch.save(audits(faulty(numbered(rows, scratch))), "audits")
    return streamed(rows, found, "conv_id long, position long, edit string, role string, text string", _rows)


def report(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``every`` has all conv_ids to report, also those without rows; the default are those of ``rows``.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    marked = scratch.save(faulty(numbered(rows, scratch)), "faulty")
    scratch.drop("numbered")
    found = scratch.save(audits(marked), "audits")
    ids = (rows if every is None else every).select(F.col("conv_id").cast("long").alias("conv_id"))
    some = counts(marked, ids)
    told_ = found.select(F.col("conv_id").alias("_c"), "illegal", "cost", "audit", F.lit(True).alias("_has"))
    met = merged_with(some, told_, some["conv_id"].eqNullSafe(told_["_c"]), "left")
    table = scratch.save(met.select("conv_id", "gaps", "blank", "duplicate", "truncated", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit")), "table")
    digests = streamed(rows, found, "conv_id long, audit string, repaired_sha256 string", _digest).select(F.col("conv_id").alias("_c"), "repaired_sha256")
    out = merged_with(table, digests, table["conv_id"].eqNullSafe(digests["_c"]), "left")
    return out.select(*table.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
