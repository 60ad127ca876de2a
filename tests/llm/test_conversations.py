"""Conversation repair against a plain search over edits, whole and in runs, and on odd inputs."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from sinoflow.llm import conversations, queries

WHITE = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit) of ``rows`` (initial, must go, broken): every edit tried from the left, the best ending kept."""

    @lru_cache(None)
    def rest(i, state, inserted):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, ""))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            for c in follows.replace("s", ""):
                cost, audit = rest(i, c, inserted + 1)
                out.append((cost + 5, "I" + audit))
        if i < len(rows):
            initial, gone, broken = rows[i]
            cost, audit = rest(i + 1, state, 0)
            out.append((cost + 2, "D" + audit))
            if not gone:
                for c in follows:
                    cost, audit = rest(i + 1, c, 0)
                    if initial == c:
                        out.append((cost + 5 * broken, "K" + audit))
                    if c != "s":
                        out.append((cost + 1 + 5 * broken, "R" + audit))
        return min(out, default=(10**9, ""))

    for i in range(len(rows), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "s", "u", "a"):
            rest(i, state, 0)
    return rest(0, "", 0)


def plain(rows, damaged=True):
    """{conv_id: the report's row} of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damaged else 9
        if h == 0:
            continue
        text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
        by[c] += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for c, own in by.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in own]
        cost, audit = cheapest(tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults, strict=True)))
        repaired, left, due = [], iter(own), "u"
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(left)
            if letter == "D":
                continue
            role = role if letter == "K" else {"u": "user", "a": "assistant"}[due]
            due = "a" if role[:1] == "u" else "u"
            repaired.append(f"{role}:{text}")
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    got = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


def test_chart_as_plain_search():
    r = random.Random(1)
    for _ in range(400):
        digits = "".join(r.choice("0123456789abcdef" if r.random() < 0.5 else "448048559") for _ in range(r.randint(0, 11)))
        rows = tuple(("suao"[int(d, 16) // 4], int(d, 16) % 4 >= 2, int(d, 16) % 4 == 1) for d in digits)
        want = cheapest(rows)
        cuts = sorted(r.choices(range(len(digits) + 1), k=r.randint(0, 4)))
        parts = [digits[a:b] for a, b in zip([0, *cuts], [*cuts, len(digits)], strict=True) if a < b]
        for pieces in ([digits] if digits else [], parts):
            assert conversations.best([{s: conversations.parse(p, s) for s in conversations.STATES} for p in pieces]) == want


@pytest.mark.parametrize("bits", [10, 1])
def test_as_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "RUN_BITS", bits)
    r = random.Random(bits)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?  ", "é."]
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ü"]), r.choice([*texts, f"text {t}.", f"more {t}", None])) for c in [*range(60), None] for t in r.sample(range(40), r.randint(1, 12))]
    rows += [(77, t, "user" if t % 2 else "assistant", f"row {t % 50}.") for t in range(300)]  # a long one
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert rows_of(conversations.report(conversations.damage(df), df)) == plain(rows)
    assert rows_of(conversations.report(df)) == plain(rows, damaged=False)
    fixed = defaultdict(list)
    for x in conversations.repaired(df).orderBy("conv_id", "position").collect():
        assert x["position"] == len(fixed[x["conv_id"]])
        fixed[x["conv_id"]].append(f"{x['role']}:{x['text']}")
    assert {c: hashlib.sha256("\n".join(fixed[c]).encode()).hexdigest() for c in {c for c, *_ in rows}} == {c: v[-1] for c, v in plain(rows, damaged=False).items()}


def test_odd_inputs(spark):
    rows = [(None, None, None, None), (None, None, "user", "A."), (1, None, "user", "Same."), (1, None, "user", "Same."), (1, 5, "assistant", "x" * 200_000 + "."), (2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b."), (3, 7, "", ""), (4, 1, "user", "one"), (4, 1, "user", "two.")]
    df = spark.createDataFrame([(*x, "own", "own", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, digest string, place int")
    got, want = rows_of(conversations.report(conversations.damage(df), df)), plain(rows)
    assert {c: v[1:] for c, v in got.items()} == {c: v[1:] for c, v in want.items()}
    assert {c: v[0] for c, v in got.items() if c != 2} == {c: v[0] for c, v in want.items() if c != 2}
    assert got[2][0] == (want[2][0] if want[2][0] < 2**63 else None)
    assert conversations.report(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0


def test_query(spark, small):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in queries.table(spark, small, "conversations").collect()]
    assert rows_of(queries.op13_conversations(spark, small)) == plain(rows)
