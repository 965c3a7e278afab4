"""Conversation structure repair by a run-length dynamic programme.

A conversation's rows become symbols: the role's initial (s, u, a or another one) with the
row's fault.  The cheapest edits that leave initials of the form ``(s?(ua)+)?`` are found over
four states (start, after s, after u, after a).  Equal consecutive symbols are one run; a run of
m rows takes the costs-to-go over m rows at once, through the binary powers of its symbol's
min-plus transition, which each worker caches.  Choices are unrolled from the front, 4,096
rows of a run at a time, taking at each step the least edit letter that still reaches the least cost.

Where the work runs.  Faults need no text: a text is its digest from the first step on.  The
narrow rows are range-partitioned on (conversation, turn, digest) and sorted, so a long
conversation lies in several tasks, each of which sends on its runs alone.  Only runs meet per
conversation, where the audit, one letter a row, is made.  The texts are shuffled once, for the
hash; a SHA-256 reads its input in order, so one conversation's texts pass one task, as a stream.

Defined results: a null role or text is one space, in the crc key a null ``conv_id`` or
``turn`` as well; null is a ``conv_id`` like any other.  Rows of one turn are in the order of
the md5 of their role's length, role and text, so equal rows are neighbours and reruns agree.
A role counts by its first character, case included; an empty or unknown role can only be
given a new role or deleted.  An empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 4, 3, 3, 3
DELETE_ONLY = 8                      # the symbol of blank and duplicate rows; the others are 2 * initial + truncated
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NEVER = 1 << 60
UNROLL = 4096
LEGAL = {(0, 1), (1, 2), (2, 1)}     # su, ua, au
ROLES = {USER: "user", ASSISTANT: "assistant"}

Costs = tuple[int, int, int, int]


# --- the programme over symbols ---------------------------------------------------------

def added(state: int) -> int:
    """The state after the user or assistant turn that may follow ``state``."""
    return ASSISTANT if state == USER else USER


def kept_state(state: int, symbol: int) -> int | None:
    """The state after keeping a row with its role; None where the form forbids it."""
    if symbol == DELETE_ONLY:
        return None
    initial = symbol >> 1
    if initial == 0:
        return SYSTEM if state == START else None
    return added(state) if initial < 3 and added(state) == initial + 1 else None


def edits(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use the row up, by letter."""
    late = TRUNCATED_COST if symbol != DELETE_ONLY and symbol & 1 else 0
    out = [("D", DELETE_COST, state)]
    if (after := kept_state(state, symbol)) is not None:
        out.append(("K", late, after))
    if symbol != DELETE_ONLY:
        out.append(("R", REROLE_COST + late, added(state)))
    return out


def end_costs() -> Costs:
    """Cost-to-go behind the last row: turns still to insert."""
    return (0, 2 * INSERT_COST, INSERT_COST, 0)


def transition(symbol: int) -> tuple[Costs, ...]:
    """Min-plus matrix of one row: any turns inserted before it, then one edit."""
    rows = []
    for state in range(4):
        least = [NEVER] * 4
        at, paid = state, 0
        for _ in range(3):  # a third inserted turn leads back to a state already reached
            for _, cost, after in edits(at, symbol):
                least[after] = min(least[after], paid + cost)
            at, paid = added(at), paid + INSERT_COST
        rows.append(tuple(least))
    return tuple(rows)


def product(a, b):
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def back(m, v: Costs) -> Costs:
    """Cost-to-go before the rows of ``m``, given that behind them."""
    v0, v1, v2, v3 = v
    return tuple(min(r[0] + v0, r[1] + v1, r[2] + v2, r[3] + v3) for r in m)


_powers: dict[int, list] = {}


def advance(symbol: int, rows: int, v: Costs) -> Costs:
    """Cost-to-go before a run, through the cached binary powers of its transition."""
    powers = _powers.setdefault(symbol, [transition(symbol)])
    k = 0
    while rows:
        if k == len(powers):
            powers.append(product(powers[-1], powers[-1]))
        if rows & 1:
            v = back(powers[k], v)
        rows >>= 1
        k += 1
    return v


def solve(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(least cost, ASCII-least audit) of a conversation given as (symbol, rows) runs."""
    behind = [end_costs()]
    for symbol, n in reversed(runs):
        behind.append(advance(symbol, n, behind[-1]))
    cost = behind.pop()[START]
    state, audit = START, []
    for symbol, n in runs:
        after_run = behind.pop()
        one = _powers[symbol][0]
        while n:
            piece = min(n, UNROLL)
            n -= piece
            costs = [advance(symbol, n, after_run)]
            for _ in range(piece):
                costs.append(back(one, costs[-1]))
            before = costs.pop()
            while costs:
                after = costs.pop()
                state = _unroll_row(symbol, state, before, after, audit)
                before = after
    end = end_costs()
    while end[state]:
        audit.append("I")
        state = added(state)
    return cost, "".join(audit)


def _unroll_row(symbol: int, state: int, before: Costs, after: Costs, audit: list[str]) -> int:
    """Append the least letters up to and with the row's own edit; the state after it."""
    while True:
        choices = edits(state, symbol)
        if choices[0][1] + after[choices[0][2]] == before[state]:
            audit.append("D")
            return state
        if INSERT_COST + before[added(state)] == before[state]:
            audit.append("I")
            state = added(state)
            continue
        for letter, cost, then in choices[1:]:
            if cost + after[then] == before[state]:
                audit.append(letter)
                return then
        raise AssertionError("no edit reaches the least cost")


# --- damage and faults ------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the seeded damage: a row is dropped, emptied, loses its
    ``[.!?]``, is repeated, or becomes the user's, one in twenty each."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_what"))
    text = F.when(F.col("_what") == 1, F.lit("")).when(F.col("_what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_what") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_what") == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.filter("_what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def row_key() -> Column:
    """Digest of role and text; also the order of rows within a turn."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, key, initial, fault): one narrow row per row of ``rows``."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    own = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = rows.select("conv_id", "turn", row_key().alias("key"), initial.alias("initial"), own.alias("own"))
    # Equal rows are counted before the shuffle; they are neighbours in the order, so a count stands for them.
    equal = narrow.groupBy("conv_id", "turn", "key", "initial", "own").agg(F.count(F.lit(1)).alias("n"))
    again = (equal.groupBy("conv_id", "key").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("early"),
                                                 F.count(F.lit(1)).alias("turns"))
             .filter("turns > 1").select(F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), "least", "early"))
    joined = equal.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("early") | (F.col("turn") > F.col("least"))), F.lit(False))
    copies = joined.select("conv_id", "turn", "key", "initial", "own", seen.alias("seen"),
                           F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("seen") | (F.col("copy") > 1), DUPLICATE).otherwise(F.col("own"))
    return copies.select("conv_id", "turn", "key", "initial", fault.cast("int").alias("fault"))


# --- runs of a task, then of a conversation -----------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BLOCK = ("part int, symbols array<int>, lengths array<bigint>, blank bigint, duplicate bigint, truncated bigint, "
          "illegal bigint, first int, last int, least bigint, most bigint, turns bigint")


class _Block:
    """What a task knows of one conversation after reading its rows in order."""

    def __init__(self, conv, initial: int):
        self.conv, self.first, self.last = conv, initial, None
        self.symbols: list[int] = []
        self.lengths: list[int] = []
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn, initial: int, fault: int) -> None:
        symbol = DELETE_ONLY if fault in (BLANK, DUPLICATE) else 2 * initial + (fault == TRUNCATED)
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += 1
        else:
            self.symbols.append(symbol)
            self.lengths.append(1)
        self.faults[fault] += 1
        if self.last is not None and (self.last, initial) not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.most:
            self.turns += 1
            self.most = turn
            self.least = turn if self.least is None else self.least

    def row(self, part: int) -> dict:
        return {"conv_id": self.conv, "part": part, "symbols": self.symbols, "lengths": self.lengths,
                "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED],
                "illegal": self.illegal, "first": self.first, "last": self.last, "least": self.least, "most": self.most,
                "turns": self.turns}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema(df: DataFrame, ddl: str) -> tuple[str, pa.Schema]:
    """The DDL with the conversation id in front, and its Arrow form."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    full = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return full, to_arrow_schema(StructType.fromDDL(full))


def blocks(rows: DataFrame) -> DataFrame:
    """One row per conversation and task with the runs the task saw; ``part`` orders a conversation's blocks."""
    ddl, arrow = _schema(rows, _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def each() -> Iterator[dict]:
            block = None
            for b in batches:
                for conv, turn, initial, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if block is None or conv != block.conv:
                        if block is not None:
                            yield block.row(part)
                        block = _Block(conv, initial)
                    block.add(turn, initial, fault)
            if block is not None:
                yield block.row(part)
        return _batches(each(), arrow)

    ordered = (rows.repartitionByRange("conv_id", "turn", "key").sortWithinPartitions("conv_id", "turn", "key")
               .select("conv_id", F.col("turn").cast("long"), "initial", "fault"))
    return ordered.mapInArrow(run, ddl)


def _merge(held: list[dict]) -> dict:
    """A conversation's result from its blocks in order."""
    runs: list[tuple[int, int]] = []
    out = {"conv_id": held[0]["conv_id"], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    last = least = most = None
    turns = 0
    for b in held:
        for symbol, n in zip(b["symbols"], b["lengths"], strict=True):
            if runs and runs[-1][0] == symbol:
                runs[-1] = (symbol, runs[-1][1] + n)
            else:
                runs.append((symbol, n))
        for k in ("blank", "duplicate", "truncated", "illegal"):
            out[k] += b[k]
        if last is not None and (last, b["first"]) not in LEGAL:
            out["illegal"] += 1
        last = b["last"]
        if b["least"] is not None:
            turns += b["turns"] - (most == b["least"])
            least, most = b["least"] if least is None else least, b["most"]
    if least is not None:
        out["gaps"] = most - least + 1 - turns
    out["cost"], out["audit"] = solve(runs)
    return out


def plan_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``rows``
    (conv_id, turn, role, text; no nulls in role and text)."""
    ddl, arrow = _schema(rows, ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            held: list[dict] = []
            for b in batches:
                for r in b.to_pylist():
                    if held and held[0]["conv_id"] != r["conv_id"]:
                        yield _merge(held)
                        held = []
                    held.append(r)
            if held:
                yield _merge(held)
        return _batches(each(), arrow)

    runs = stored(blocks(symbols(rows)), "conversation-blocks")
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, ddl)


# --- the repaired turns -------------------------------------------------------------------

class _Replay:
    """Yields the repaired (role, text) turns of one conversation, fed its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _insert(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = added(self.state)
            yield ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = SYSTEM if role[0] == "s" else added(self.state)
            yield role, text
        elif letter == "R":
            self.state = added(self.state)
            yield ROLES[self.state], text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insert()


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Every conversation's plan, then its rows in order, in one partition's stream."""
    marks = plans.select("conv_id", F.lit(0).alias("mark"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                         F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), *COUNTS, "audit")
    turns = rows.select("conv_id", F.lit(1).alias("mark"), "turn", row_key().alias("key"), "role", "text",
                        *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    return (marks.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "mark", "turn", "key")
            .select("conv_id", "mark", "role", "text", *COUNTS, "audit"))


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations, turn by turn."""
    ddl, arrow = _schema(rows, "position bigint, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            conv = replay = None
            position = 0
            for b in batches:
                for r in b.to_pylist():
                    if r["mark"] == 0:
                        done, replay_done = conv, replay
                        turns = replay_done.end() if replay_done else ()
                    else:
                        done, turns = conv, replay.row(r["role"], r["text"])
                    for role, text in turns:
                        yield {"conv_id": done, "position": position, "role": role, "text": text}
                        position += 1
                    if r["mark"] == 0:
                        conv, replay, position = r["conv_id"], _Replay(r["audit"]), 0
            for role, text in replay.end() if replay else ():
                yield {"conv_id": conv, "position": position, "role": role, "text": text}
                position += 1
        return _batches(each(), arrow)

    return _in_order(rows, plans).mapInArrow(run, ddl)


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with ``repaired_sha256``, the hash of the repaired ``role:text`` lines.

    The texts are hashed as they come by, so a conversation of any length takes the memory of
    one batch and its audit."""
    ddl, arrow = _schema(rows, ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            plan = replay = sha = None
            empty = True

            def put(turns) -> None:
                nonlocal empty
                for role, text in turns:
                    sha.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
                    empty = False

            for b in batches:
                for r in b.to_pylist():
                    if r["mark"]:
                        put(replay.row(r["role"], r["text"]))
                        continue
                    if plan is not None:
                        put(replay.end())
                        yield plan | {"repaired_sha256": sha.hexdigest()}
                    plan = {k: r[k] for k in ("conv_id", *COUNTS, "audit")}
                    replay, sha, empty = _Replay(r["audit"]), hashlib.sha256(), True
            if plan is not None:
                put(replay.end())
                yield plan | {"repaired_sha256": sha.hexdigest()}
        return _batches(each(), arrow)

    return _in_order(rows, plans).mapInArrow(run, ddl)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, plan and hash: one row for every ``conv_id`` of ``conversations``."""
    rows = damaged(conversations)
    plans = plan_repairs(rows).withColumnRenamed("conv_id", "_conv")
    everyone = conversations.select("conv_id").distinct()
    whole = everyone.join(plans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))
    return repaired_digests(rows, whole)
