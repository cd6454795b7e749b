"""Repair of conversations to the alternation of an optional system turn and user/assistant pairs, at the lowest cost.

Faults of a turn, the first that fits: blank (no character but white space), duplicate (role and text seen earlier in the conversation),
truncated (the last character that is no white space is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 2,
Delete 3 (required for blank and duplicate turns), Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.
The cheapest edits win, of equally cheap ones those with the ASCII-least audit (their initials in order).

A turn is one character: its role's initial and its fault. A conversation's characters are aligned to each feasible length of the target
``s?(ua)*`` by Wagner and Fischer's table. Targets end alike, so the lengths share one table of suffixes; Ukkonen's band leaves out cells
that cannot lie on a path as cheap as an incumbent, which is at first a plain repair without insertions inside. The cheapest lengths are
traced back, and their audits compared. Where a conversation is so long that the band has more than ``CELLS`` cells, the columns of all
lengths of one parity are folded into one, which leaves four states a turn and gives the same audit in linear time and a
byte a turn of memory.

Turns are dealt by ranges of (conv_id, turn, role, hash of text), so a conversation with a third of all turns is spread; duplicates are
found through the first place of each (conversation, role, hashes of text), an aggregate that combines before the shuffle. Only characters are
collected, one byte a turn, as many as the audit has in the result. The digest of the repaired turns runs over the sorted
turns of a conversation as a stream: one turn at a time in memory, though one conversation's digest is one task's work by nature.

Defined cases: null texts and roles are one space, so a null text is blank; null conv_ids are one conversation; null turns come first;
turns of the same number are ordered by role and a hash of the text, equal rows follow each other, and all but the first are
duplicates; a role is what its first character says (an empty one is illegal anywhere); an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import store

CELLS = 1 << 20
BLOCK = 4096
ROLES, TRUNCATED, DUPLICATE, BLANK = "sua", 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, STUMP = 0, 2, 3, 2, 1
INF = 1 << 60

Turn = tuple[str, int]  # initial of the role ("x": any other), fault


def turns(codes: str) -> list[Turn]:
    return [("suax"[k >> 2], k & 3) for k in (ord(c) - 97 for c in codes)]


def code(role: Column, fault: Column) -> Column:
    """One letter for a turn; the inverse of ``turns``."""
    initial = F.substring(role, 1, 1)
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(97) + at * 4 + fault)


def _incumbent(rows: list[Turn]) -> int:
    """Cost of a repair that is always possible: delete everything, or rerole every live turn to its place and fill up the end."""
    cost, place = 0, 0
    for role, fault in rows:
        if fault >= DUPLICATE:
            cost += DELETE
        else:
            cost += (KEEP if role == "ua"[place & 1] else REROLE) + STUMP * (fault == TRUNCATED)
            place += 1
    return min(DELETE * len(rows), cost + INSERT * (place & 1))


class Table:
    """``at(i, r)``: least cost to turn rows i, i + 1, … into the last r characters of an alternation that ends in "a"."""

    def __init__(self, rows: list[Turn], bound: int):
        live, self.low = [0] * (len(rows) + 1), []
        for i in range(len(rows) - 1, -1, -1):
            live[i] = live[i + 1] + (rows[i][1] < DUPLICATE)
        spare = bound - DELETE * (len(rows) - live[0])  # what a path may spend on top of required deletions
        below, above = spare // DELETE, spare // INSERT
        self.rows, self.width = rows, below + above + 1
        self.low = [n - below for n in live]  # first r inside the band, of each row
        self.cost: list[list[int]] = [[]] * (len(rows) + 1)
        if not self.too_large():
            self._fill()

    def too_large(self) -> bool:
        return self.width * (len(self.rows) + 1) > CELLS

    def _fill(self) -> None:
        n = len(self.rows)
        self.cost[n] = [INSERT * r if r >= 0 else INF for r in range(self.low[n], self.low[n] + self.width)]
        for i in range(n - 1, -1, -1):
            role, fault = self.rows[i]
            out: list[int] = []
            before = INF  # of (i, r - 1)
            for r in range(self.low[i], self.low[i] + self.width):
                best = INF
                if r >= 0:
                    best = min(self.at(i + 1, r) + DELETE, before + INSERT)
                    if r > 0 and fault < DUPLICATE:
                        best = min(best, self.at(i + 1, r - 1) + self.step(role, fault, r))
                out.append(best)
                before = best
            self.cost[i] = out

    @staticmethod
    def step(role: str, fault: int, r: int) -> int:
        return (KEEP if role == "ua"[r & 1] else REROLE) + STUMP * (fault == TRUNCATED)

    def at(self, i: int, r: int) -> int:
        k = r - self.low[i]
        return self.cost[i][k] if 0 <= k < self.width else INF

    def trace(self, i: int, r: int) -> str:
        """The ASCII-least of the cheapest edits from (i, r)."""
        out: list[str] = []
        while i < len(self.rows) or r:
            here = self.at(i, r)
            if i < len(self.rows) and here == self.at(i + 1, r) + DELETE:
                out.append("D")
                i += 1
            elif r and here == self.at(i, r - 1) + INSERT:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.rows[i][0] == "ua"[r & 1] else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def by_lengths(rows: list[Turn], table: Table) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, over all feasible lengths of the target."""
    n = len(rows)
    best = (DELETE * n, "D" * n)  # the empty target
    starts = [(0, 0, "")]  # first row of the alternation, cost and audit before it: nothing, or deletions and a kept system turn
    starts += [(p + 1, DELETE * p + STUMP * (fault == TRUNCATED), "D" * p + "K") for p, (role, fault) in enumerate(rows) if role == "s" and fault < DUPLICATE and DELETE * p <= best[0]]
    for first, before, audit in starts:
        for r in range(max(2, table.low[first] + (table.low[first] & 1)), table.low[first] + table.width, 2):
            cost = before + table.at(first, r)
            if cost <= best[0]:
                best = min(best, (cost, audit + table.trace(first, r)))
    return best


# The same with the lengths of one parity folded. States: 0 nothing yet, 1 after "s", 2 after "u", 3 after "a".
_NEXT = (2, 2, 3, 2)
_WANTS = ("su", "u", "a", "u")


def _moves(q: int, turn: Turn) -> list[tuple[str, int, int]]:
    """Edits of a live turn in a state: initial, cost, state after it."""
    role, fault = turn
    extra = STUMP * (fault == TRUNCATED)
    keep = [("K", KEEP + extra, 1 if role == "s" else _NEXT[q])] if role in _WANTS[q] else []
    return [*keep, ("R", REROLE + extra, _NEXT[q])]


def _backwards(rows: list[Turn], after: list[int]) -> list[list[int]]:
    """Least cost to the end from each row and state, given that after the last of ``rows``."""
    out = [after]
    for turn in reversed(rows):
        w = [v + DELETE for v in after]
        if turn[1] < DUPLICATE:
            w = [min(w[q], *(after[to] + c for _, c, to in _moves(q, turn))) for q in range(4)]
        after = [min(w[q], w[_NEXT[q]] + INSERT, w[_NEXT[_NEXT[q]]] + 2 * INSERT) for q in range(4)]
        out.append(after)
    return out[::-1]


def folded(codes: str) -> tuple[int, str]:
    """Cost and audit as by ``by_lengths``; costs are kept at block borders only and computed again block by block."""
    starts = range(0, len(codes), BLOCK)
    borders = [[0, 2 * INSERT, INSERT, 0]]
    for s in reversed(starts):
        borders.append(_backwards(turns(codes[s : s + BLOCK]), borders[-1])[0])
    borders.reverse()
    out, q = [], 0
    for s, after in zip(starts, borders[1:], strict=True):
        rows = turns(codes[s : s + BLOCK])
        costs = _backwards(rows, after)
        for i, turn in enumerate(rows):
            while costs[i][q] != costs[i + 1][q] + DELETE and costs[i][q] == costs[i][_NEXT[q]] + INSERT:
                out.append("I")
                q = _NEXT[q]
            if costs[i][q] == costs[i + 1][q] + DELETE:
                out.append("D")
                continue
            edit, q = next((e, to) for e, c, to in _moves(q, turn) if costs[i][q] == c + costs[i + 1][to])
            out.append(edit)
    while borders[-1][q]:
        out.append("I")
        q = _NEXT[q]
    return borders[0][0], "".join(out)


def align(codes: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a conversation."""
    rows = turns(codes) if len(codes) <= CELLS else []
    if not rows:
        return folded(codes)
    table = Table(rows, _incumbent(rows))
    return folded(codes) if table.too_large() else by_lengths(rows, table)


def judge(codes: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost, audit."""
    count = [sum(codes.count(chr(97 + 4 * role + fault)) for role in range(4)) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    roles = "".join("suax"[(ord(c) - 97) >> 2] for c in codes)
    legal = sum(roles.count(pair) for pair in ("su", "ua", "au"))
    return (*count, max(0, len(codes) - 1) - legal, *align(codes))


_judge_short = lru_cache(1 << 16)(judge)
JUDGED = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(_judge_short if len(c) <= 64 else judge)(c) for c in batch.column("codes").to_pylist()]
        columns = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*out, strict=True) if out else [()] * 6)]
        kept = [(n, batch.column(n)) for n in batch.schema.names if n != "codes"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *columns], names=[*(n for n, _ in kept), "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


class Repaired:
    """Turns of one conversation by its audit, as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out = audit, 0, 0
        self.lead = (len(audit) - audit.count("D")) & 1  # an odd number of turns starts with the system's
        self.digest = sha256()

    def _role(self) -> bytes:
        return b"assistant" if (self.out - self.lead) & 1 else b"user"

    def _emit(self, role: bytes, text: bytes) -> None:
        if self.out:
            self.digest.update(b"\n")
        self.digest.update(role + b":")
        self.digest.update(text)
        self.out += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._emit(self._role(), b"")
            self.at += 1

    def turn(self, role: bytes, text: bytes) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._emit(role if edit == "K" else self._role(), text)

    def hex(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns, each conversation's audit in a row before them, to one digest a conversation."""
    head, now = None, None
    for batch in batches:
        done: list[tuple] = []
        for place, role, text, audit, facts in zip(*(batch.column(c).to_pylist() for c in ("place", "role", "text", "audit", "facts")), strict=True):
            if place >= 0:
                now.turn(role, text)
                continue
            if now:
                done.append((head, now.audit, now.hex()))
            head, now = facts, Repaired(audit)
        if done:
            yield _digests(done, batch)
    if now:
        yield _digests([(head, now.audit, now.hex())], batch)


def _digests(done: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    facts, audits, digests = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(facts, batch.schema.field("facts").type), pa.array(audits, pa.string()), pa.array(digests, pa.string())], names=["facts", "audit", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with one fault in four of them, chosen by the CRC-32 of "conv_id:turn" modulo 20. A dropped turn
    stays as a row that is ``gone``, so that its conversation keeps its row."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat_ws(":", *name), "utf-8")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), (kind == 3).alias("twice"))
    copies = F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", "gone", copies.alias("copy")).drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """Repairs ``rows`` (conv_id, turn, role, text without nulls, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256 of each conversation; rows that are gone only name theirs."""
    order = ["conv_id", "turn", "role", "a", "b", "tie"]
    hashed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.monotonically_increasing_id().alias("tie"))
    placed = hashed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "a", "b", F.monotonically_increasing_id().alias("place"))
    placed = store(placed).df

    here = placed.filter(~F.col("gone"))
    firsts = here.groupBy("conv_id", "role", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = firsts.toDF("c", "r", "x", "y", "first")
    said = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
    marked = placed.select("conv_id", "role", "gone", "a", "b", "place", (said == "").alias("blank"), F.substring(said, -1, 1).isin(".", "!", "?").alias("ended"))
    marked = marked.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), DUPLICATE).when(F.col("ended"), 0).otherwise(TRUNCATED)
    letters = marked.select("conv_id", "place", F.when(F.col("gone"), "").otherwise(code(F.col("role"), fault)).alias("code"))
    inside = letters.groupBy("conv_id", F.shiftright("place", 12).alias("block")).agg(_joined("place", "code").alias("codes"))
    whole = inside.groupBy("conv_id").agg(_joined("block", "codes").alias("codes"))

    spans = here.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("n"))
    wide = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("n").cast("decimal(20,0)")
    gaps = F.least(wide, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    whole = whole.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left").select("conv_id", F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"), "codes")
    facts = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = placed.schema["conv_id"].dataType.simpleString()
    judged = whole.mapInArrow(judge_rows, f"conv_id {kind}, gaps long, {JUDGED}")

    heads = judged.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("role"), F.lit(None).cast("binary").alias("text"), "audit", F.struct(*facts).alias("facts"))
    none = F.lit(None).cast(heads.schema["facts"].dataType)
    spoken = here.select("conv_id", "place", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), F.lit(None).cast("string").alias("audit"), none.alias("facts"))
    sorted_ = heads.unionByName(spoken).repartition("conv_id").sortWithinPartitions("conv_id", "place").drop("conv_id")
    out = sorted_.mapInArrow(digest_rows, f"facts {heads.schema['facts'].dataType.simpleString()}, audit string, repaired_sha256 string")
    return out.select(*[f"facts.{c}" for c in facts], "audit", "repaired_sha256")


def _joined(order: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")
