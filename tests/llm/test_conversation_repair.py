"""Conversation repair against a plain programme that compares whole edit strings."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from issuelens.llm import conversation_repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_solve(rows):
    """(cost, audit, turns) by keeping the least (cost, audit) per form state and row; rows: (role, text, fault)."""
    step = {0: "U", 1: "U", 2: "A", 3: "U"}
    number = {"U": 2, "A": 3}

    # All (cost, audit) pairs that may still win are kept: ties are decided on the whole string at the end.
    layers = {0: {(0, ""): []}}

    def widen(layers):
        out = {q: dict(v) for q, v in layers.items()}
        todo = [(q, k, t) for q, v in layers.items() for k, t in v.items()]
        for _ in range(3):
            new = []
            for q, (c, a), t in todo:
                nxt = number[step[q]]
                k = (c + 3, a + "I")
                if k not in out.setdefault(nxt, {}):
                    out[nxt][k] = [*t, ("user" if nxt == 2 else "assistant", "")]
                    new.append((nxt, k, out[nxt][k]))
            todo = new
        return out

    for role, text, fault in rows:
        out = {}
        for q, v in widen(layers).items():
            for (c, a), t in v.items():
                out.setdefault(q, {}).setdefault((c + 4, a + "D"), t)
                if fault in ("blank", "duplicate"):
                    continue
                late = 3 if fault == "truncated" else 0
                nxt = number[step[q]]
                ini = role[:1]
                if ini == "s" and q == 0:
                    out.setdefault(1, {}).setdefault((c + late, a + "K"), [*t, (role, text)])
                if ini == "ua"[nxt - 2]:
                    out.setdefault(nxt, {}).setdefault((c + late, a + "K"), [*t, (role, text)])
                out.setdefault(nxt, {}).setdefault((c + 3 + late, a + "R"), [*t, ("user" if nxt == 2 else "assistant", text)])
        layers = {}
        for q, v in out.items():
            low = min(c for c, _ in v)
            layers[q] = {k: t for k, t in v.items() if k[0] == low}
    ends = {k: t for q, v in widen(layers).items() if q in (0, 3) for k, t in v.items()}
    best = min(ends)
    return best[0], best[1], ends[best]


def plain(rows):
    """The contract's rows by plain Python."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = "".join(c for c in text if c not in ".!?")
        if what == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if what == 3 else 1)
    result = {}
    for conv, found in out.items():
        key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
        found.sort(key=key)
        seen, faulty = set(), []
        for _, role, text in found:
            bare = text.rstrip(BLANKS)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = lambda k: sum(f == k for _, _, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:], strict=False))
        cost, audit, fixed = plain_solve(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        result[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha, fixed)
    return result


def some_rows(n_convs, seed, longest=7):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant"]
    texts = ["Fine.", "Open", "  ", "", None, "Why?", "Fine.", "Ein Satz!\n", "x" * 40 + ".", "No end \t"]
    rows = []
    for conv in range(n_convs):
        turn = 0
        for i in range(rng.randrange(0, longest + 1)):
            role = ("user", "assistant")[i % 2] if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    return rows


def collected(df):
    return {r["conv_id"]: (*[r[c] for c in R.COUNTS], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return [*some_rows(300, 5), (None, None, None, None), (None, 3, "user", "Hi."), (None, 4, "assistant", "Ho."), *[(900, 1, "user", "Same.")] * 9]


def test_equals_the_plain_version(spark, rows):
    got = collected(R.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    want = plain(rows)
    assert got.keys() == want.keys()
    wrong = {c: (got[c], w[:8]) for c, w in want.items() if got[c] != w[:8]}
    assert not wrong
    assert len({w[6] for w in want.values()}) > 40  # many different audits


def test_turns_are_those_that_the_hash_reads(spark, rows):
    df = R.damaged(spark.createDataFrame(rows, SCHEMA))
    turns = {}
    for r in R.repaired_turns(df, R.plan_repairs(df)).orderBy("position").collect():
        turns.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["text"]))
    want = {c: w[8] for c, w in plain(rows).items() if w[8]}
    assert {c: [(r, t) for _, r, t in v] for c, v in turns.items()} == want
    assert all([p for p, _, _ in v] == list(range(len(v))) for v in turns.values())


def test_one_long_conversation_over_many_tasks(spark):
    """A conversation of most rows, cut over range partitions and long runs, as in one task."""
    rng = random.Random(3)
    rows, turn = [], 0
    for n in (3000, 1, 2, 5000, 40, 9000):
        role = rng.choice(["user", "assistant", "tool"])
        for _ in range(n):
            rows.append((1, turn, role, f"Line {turn}" + rng.choice([".", "."])))
            turn += 1
    rows += some_rows(20, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = collected(R.repair_damaged(df.repartition(6)))
    few = collected(R.repair_damaged(df.coalesce(1)))
    assert got == few
    assert len(got[1][6]) >= 17000
    want = plain([r for r in rows if r[0] != 1])
    assert {c: v for c, v in got.items() if c not in (1,)} == {c: w[:8] for c, w in want.items() if c != 1}


@pytest.mark.parametrize("symbol", range(9))
def test_powers_equal_steps(symbol):
    v = R.end_costs()
    one = R.transition(symbol)
    for n in range(1, 70):
        v = R.back(one, v)
        assert R.advance(symbol, n, R.end_costs()) == v


def test_unrolling_long_runs_in_pieces(monkeypatch):
    rng = random.Random(1)
    cases = [[(rng.randrange(9), rng.choice([1, 1, 2, 3, 9, 30])) for _ in range(rng.randrange(1, 8))] for _ in range(300)]
    whole = [R.solve(c) for c in cases]
    monkeypatch.setattr(R, "UNROLL", 4)
    assert [R.solve(c) for c in cases] == whole


def test_empty_table_and_clashing_columns(spark, rows):
    assert R.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    plain_df = spark.createDataFrame(rows[:200], SCHEMA)
    more = plain_df.select("*", *[F.lit(1).alias(c) for c in ("mark", "key", "cost", "audit", "part", "_what", "_conv", "fault", "n")])
    assert collected(R.repair_damaged(more)) == collected(R.repair_damaged(plain_df))


def test_all_rows_dropped(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = collected(R.repair_damaged(spark.createDataFrame([(7, gone, "user", "Hi.")], SCHEMA)))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
