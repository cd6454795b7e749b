"""Blocked ordered steps against plain loops, with blocks far smaller than the documents."""

import random

import pytest
from pyspark.sql import functions as F

from studylake.functions.sequence import automaton, carry, neighbours, range_join, successor

BLOCK = 4


def rows(seed, docs=5, most=40):
    rnd = random.Random(seed)
    out = []
    for d in range(docs):
        at = -1
        for _ in range(rnd.randint(1, most)):
            at += rnd.choice([1, 1, 1, 2, 9])
            out.append((d, at, rnd.choice([None, 1, 2, 3]), rnd.random() < 0.2))
    rnd.shuffle(out)
    return out


def by_doc(data):
    docs = {}
    for d, n, v, r in sorted(data, key=lambda x: (x[0], x[1])):
        docs.setdefault(d, []).append((n, v, r))
    return docs


def fold(kind, values):
    values = [v for v in values if v is not None]
    if kind == "sum":
        return sum(values)
    if not values:
        return None
    return {"max": max, "min": min, "last": lambda v: v[-1], "first": lambda v: v[0]}[kind](values)


@pytest.mark.parametrize("kind", ["sum", "max", "min", "last", "first"])
def test_carry(spark, kind):
    data = rows(kind)
    df = spark.createDataFrame(data, "doc_id int, n int, v int, r boolean")
    v = F.col("v")
    got = carry(
        df, ["doc_id"], "n",
        {"upto": (kind, v, "upto"), "before": (kind, v, "before"), "after": (kind, v, "after"), "whole": (kind, v, "all"), "since": (kind, v, F.col("r"))},
        BLOCK,
    )
    want = set()
    for d, seq in by_doc(data).items():
        vals = [x[1] for x in seq]
        for i, (n, _, _) in enumerate(seq):
            start = max((j for j in range(i + 1) if seq[j][2]), default=0)
            parts = (vals[: i + 1], vals[:i], vals[i + 1 :], vals, vals[start : i + 1])
            want.add((d, n, *[fold(kind, p) for p in parts]))
    names = ("upto", "before", "after", "whole", "since")
    zero = (lambda x: x or 0) if kind == "sum" else (lambda x: x)
    assert {(r.doc_id, r.n, *[zero(r[c]) for c in names]) for r in got.collect()} == want


def test_neighbours(spark):
    data = rows(7)
    df = spark.createDataFrame(data, "doc_id int, n int, v int, r boolean")
    got = neighbours(df, ["doc_id"], "n", ["n"], before=2, after=3, block=BLOCK)
    want = set()
    for d, seq in by_doc(data).items():
        ns = [x[0] for x in seq]
        at = lambda i: ns[i] if 0 <= i < len(ns) else None
        want |= {(d, n, at(i - 1), at(i - 2), at(i + 1), at(i + 2), at(i + 3)) for i, n in enumerate(ns)}
    pick = lambda s: s.n if s is not None else None
    assert {(r.doc_id, r.n, *[pick(r[c]) for c in ("prev1", "prev2", "next1", "next2", "next3")]) for r in got.collect()} == want


def test_range_join(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "doc_id int, n int, v int, r boolean")
    ranges = spark.createDataFrame([(0, 2, 17), (1, 0, 5), (1, 4, 90), (3, 6, 7)], "doc_id int, s int, e int")
    got = range_join(df, ranges, ["doc_id"], "n", "s", "e", BLOCK).select("doc_id", "n", "s")
    want = sorted((d, n, s) for d, n, _, _ in data for rd, s, e in [(0, 2, 17), (1, 0, 5), (1, 4, 90), (3, 6, 7)] if rd == d and s <= n < e)
    assert sorted((r.doc_id, r.n, r.s) for r in got.collect()) == want


def test_first_stop_after_a_start(spark):
    """Against a plain search, over many small blocks; a start may have no stop, and stops before it do not count."""
    rng = random.Random(2)
    starts = [(d, rng.randrange(60), rng.randint(1, 3)) for d in range(12)]
    stops = [(d, at, rng.randint(1, 4)) for d in range(12) for at in rng.sample(range(70), rng.randint(0, 25))]
    a = spark.createDataFrame(starts, "doc_id int, start int, level int")
    b = spark.createDataFrame(stops, "doc_id int, stop int, depth int")
    for block in (1, 4, 16, 4096):
        got = successor(a, b, ["doc_id"], "start", "stop", ["depth"], F.col("depth") <= F.col("level"), block).collect()
        want = {(d, s): min(x for e, x, depth in stops if e == d and x > s and depth <= level) for d, s, level in starts if any(e == d and x > s and depth <= level for e, x, depth in stops)}
        assert {(r.doc_id, r.start): r.stop for r in got} == want and len(got) == len(want)


def test_automaton_over_blocks(spark):
    """A divider takes the rows that it needs, over block borders and in a run of 100,000 rows."""
    rng = random.Random(8)
    docs = {d: "".join(rng.choice("ab0") for _ in range(n)) for d, n in enumerate([1, 5, 40, 90])}
    docs[9] = "".join(rng.choice("ab") for _ in range(100_000))
    step = lambda left, c: F.when(left > 0, left - 1).when(c == "a", 3).otherwise(0)
    flag = lambda left, c: (left > 0) | (c == "a")
    rows = spark.createDataFrame([(d, i, c) for d, s in docs.items() for i, c in enumerate(s)], "doc_id int, line_no int, c string")
    want = set()
    for d, s in docs.items():
        left = 0
        for i, c in enumerate(s):
            if left or c == "a":
                want.add((d, i))
            left = left - 1 if left else 3 if c == "a" else 0
    got = automaton(rows.where("doc_id < 9"), ["doc_id"], "line_no", F.col("c"), 4, step, flag, "hit", 7)
    long = automaton(rows.where("doc_id = 9"), ["doc_id"], "line_no", F.col("c"), 4, step, flag, "hit")
    assert {(r.doc_id, r.line_no) for part in (got, long) for r in part.collect()} == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_short_documents_need_one_exchange(spark):
    from studylake.operators.structure import pipe_rows, section_lines

    lines = spark.createDataFrame([(d, i, t) for d in range(3) for i, t in enumerate(["1. A", "| a | b |", "|---|---|", "| c | |", "text"])], "doc_id int, line_no int, text string")
    assert exchanges(pipe_rows(lines)) == 1
    assert exchanges(section_lines(lines)) == 1
    assert [(r.line_no, r.is_header, r.cells) for r in pipe_rows(lines).where("doc_id = 1").orderBy("line_no").collect()] == [(1, True, ["a", "b"]), (3, False, ["c", ""])]


def test_documents_of_one_block_and_longer_ones(spark):
    """Documents of at most 40 positions as one block each, some as several blocks: the same values."""
    df = spark.createDataFrame(rows("mixed"), "doc_id int, n int, v int, r boolean")
    v = F.col("v")
    specs = {f"{kind}_{frame}": (kind, v, frame) for kind in ("sum", "max", "first", "last") for frame in ("upto", "before", "after", "all")}
    specs |= {f"{kind}_since": (kind, v, F.col("r")) for kind in ("sum", "min", "first", "last")}
    short, mixed, long = (sorted(map(repr, carry(df, ["doc_id"], "n", specs, b).collect())) for b in (10**6, 30, BLOCK))
    assert short == mixed == long
    near = [sorted(map(repr, neighbours(df, ["doc_id"], "n", ["n", "v"], 2, 3, b).collect())) for b in (10**6, 30, BLOCK)]
    assert near[0] == near[1] == near[2]
