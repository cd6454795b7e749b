"""Ordered operations within a document, in bounded blocks.

A plain ``Window.partitionBy(doc).orderBy(line_no)`` puts a whole document into one task,
which breaks when one document holds a large share of all rows. Here rows are cut into blocks
of ``BLOCK`` consecutive positions. Windows run inside ``(keys, block)``; what a block needs
from its neighbours is a short summary, aggregated map-side, combined over the blocks of a
document (a table ``BLOCK`` times smaller) and joined back on ``(keys, block)``.

Documents that end within their first block need none of this: they are put together once and read
in order. Which documents are longer is asked first, by a filter on positions that reaches the scan.

Positions must be non-negative integers, unique within ``keys``; they need not be dense.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.stage import stage

BLOCK = 4096
_B = "_block"

# kind -> (aggregate over a block, combination of the carried and the local result)
_FOLDS = {
    "sum": (F.sum, lambda far, near: F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))),
    "max": (F.max, lambda far, near: F.greatest(far, near)),
    "min": (F.min, lambda far, near: F.least(far, near)),
    "last": (None, lambda far, near: F.coalesce(near, far)),
    "first": (None, lambda far, near: F.coalesce(far, near)),
}


_REVERSED = {"first": "last", "last": "first"}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(window)
    return _FOLDS[kind][0](value).over(window)


def _total(kind: str, value: Column, order: str) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), F.col(order)))
    return _FOLDS[kind][0](value)


class Steps(NamedTuple):
    """Ordered steps for documents of one length; ``whole``: they are documents of one block."""

    whole: bool
    carry: Callable[..., DataFrame]
    near: Callable[..., DataFrame]
    automaton: Callable[..., DataFrame]

    def deal(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Short documents dealt out by ``keys`` to a fixed number of tasks, for steps that cost far more than moving rows: by
        their size alone they would be put together into few. Longer documents stay as they are."""
        return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys) if self.whole else rows


def by_length(df: DataFrame, keys: list[str], order: str, steps: Callable[[DataFrame, Steps], DataFrame], block: int = BLOCK) -> DataFrame:
    """``steps`` on the documents of one block and on longer ones, put together again.

    The given ``carry(rows, specs)``, ``near(rows, columns, before, after)`` and ``automaton(rows, letter, states, step, flag,
    out, rest)`` are the functions of this module for such documents; ``rest`` is a letter after which the state is 0 and that is never flagged. Several in a row need one exchange where documents are short.
    """
    beyond = df.where(F.col(order) >= block).select(*keys)
    short = Steps(True, *[partial(f, keys=keys, order=order) for f in (_carry_whole, _near_whole, _automaton_whole)])
    if beyond.isEmpty():
        return steps(df, short)
    longer = stage(beyond.distinct())
    long = Steps(False, *[partial(f, keys=keys, order=order, block=block) for f in (_carry_blocks, _near_blocks, _automaton_blocks)])
    return steps(df.join(longer, keys, "left_anti"), short).unionByName(steps(df.join(longer, keys, "left_semi"), long))


def carry(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: Mapping[str, tuple[str, Column, str | Column]],
    block: int = BLOCK,
) -> DataFrame:
    """Adds running or document-wide values.

    ``specs`` maps a new column to ``(kind, value, frame)``. Kinds: ``sum``, ``max``, ``min``,
    ``last`` and ``first`` (last/first non-null value by position). Frames: ``upto`` (start of
    the document through this row), ``before`` (excluding this row), ``after`` (following
    rows), ``all`` (the whole document), or a boolean column: rows since it was last true,
    that row included. The value of the next row is ``first``/``after``, of the previous row
    ``last``/``before``, when it is never null.
    """
    return by_length(df, keys, order, lambda rows, step: step.carry(rows, specs), block)


def _carry_whole(df: DataFrame, specs: Mapping[str, tuple[str, Column, str | Column]], keys: list[str], order: str) -> DataFrame:
    """:func:`carry` for documents of one block. All windows are within the document, so later steps find it in order."""
    values = [value.alias(f"_v_{n}") for n, (_, value, _) in specs.items()]
    resets = {n: F.coalesce(f, F.lit(False)).cast("int").alias(f"_r_{n}") for n, (_, _, f) in specs.items() if not isinstance(f, str)}
    inside = Window.partitionBy(*keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    frames = {
        "upto": upto,
        "before": inside.rowsBetween(Window.unboundedPreceding, -1),
        "all": inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
        "after": back,
    }
    rows = df.select("*", *values, *resets.values())
    if resets:
        rows = rows.select("*", *[F.sum(f"_r_{n}").over(upto).alias(f"_s_{n}") for n in resets])
    out = []
    for n, (kind, _, frame) in specs.items():
        value = F.col(f"_v_{n}")
        zero = (lambda x: F.coalesce(x, F.lit(0))) if kind == "sum" else (lambda x: x)
        if n in resets:
            near = _over(kind, value, Window.partitionBy(*keys, f"_s_{n}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
            out.append(F.when(F.col(f"_s_{n}") == 0, zero(near)).otherwise(near).alias(n))
        elif frame == "all":
            out.append(_over(kind, value, frames[frame]).alias(n))
        else:
            seen = _REVERSED.get(kind, kind) if frame == "after" else kind
            out.append(zero(_over(seen, value, frames[frame])).alias(n))
    return rows.select(*[c for c in df.columns if c not in specs], *out)


def _carry_blocks(
    df: DataFrame, specs: Mapping[str, tuple[str, Column, str | Column]], keys: list[str], order: str, block: int
) -> DataFrame:
    """:func:`carry` for documents of any length."""
    df = stage(df)
    values = {n: (kind, value.alias(f"_v_{n}"), frame) for n, (kind, value, frame) in specs.items()}
    resets = {n: F.coalesce(f, F.lit(False)).cast("int").alias(f"_r_{n}") for n, (_, _, f) in specs.items() if not isinstance(f, str)}
    blocked = df.select(
        "*", F.floor(F.col(order) / F.lit(block)).alias(_B), *[v for _, v, _ in values.values()], *resets.values()
    )
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    if resets:
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        blocked = blocked.select("*", *[F.sum(f"_r_{n}").over(upto).alias(f"_s_{n}") for n in resets])
        whole = Window.partitionBy(*keys, _B)
        summed = blocked.select("*", *[F.max(f"_s_{n}").over(whole).alias(f"_m_{n}") for n in resets])
    else:
        summed = blocked

    by_block = Window.partitionBy(*keys).orderBy(_B)
    # Following rows are read as preceding ones in reverse order: a frame that shrinks with every
    # row would be evaluated anew for each.
    back_inside = Window.partitionBy(*keys, _B).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    back_by_block = Window.partitionBy(*keys).orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts, carried = [], []
    for n, (kind, _, frame) in specs.items():
        value, part = F.col(f"_v_{n}"), f"_p_{n}"
        if n in resets:
            value = F.when(F.col(f"_s_{n}") == F.col(f"_m_{n}"), value)
            parts.append(F.max(f"_m_{n}").alias(f"_m_{n}"))
        parts.append(_total(kind, value, order).alias(part))
    summary = summed.groupBy(*keys, _B).agg(*parts)
    for n in resets:
        begun = F.sum((F.col(f"_m_{n}") > 0).cast("int")).over(by_block.rowsBetween(Window.unboundedPreceding, 0))
        summary = summary.withColumn(f"_g_{n}", begun)
        group = Window.partitionBy(*keys, f"_g_{n}").orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
        summary = summary.withColumn(f"_a_{n}", _over(specs[n][0], F.col(f"_p_{n}"), group))
    for n, (kind, _, frame) in specs.items():
        if n in resets:
            carried.append(F.lag(f"_a_{n}").over(by_block).alias(f"_c_{n}"))
            continue
        if frame == "all":
            window = by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        elif frame == "after":
            window = back_by_block
        else:
            window = by_block.rowsBetween(Window.unboundedPreceding, -1)
        seen = _REVERSED.get(kind, kind) if frame == "after" else kind
        carried.append(_over(seen, F.col(f"_p_{n}"), window).alias(f"_c_{n}"))
    joined = blocked.join(summary.select(*keys, _B, *carried), [*keys, _B])

    out = []
    for n, (kind, _, frame) in specs.items():
        far, value, combine = F.col(f"_c_{n}"), F.col(f"_v_{n}"), _FOLDS[kind][1]
        if n in resets:
            segment = Window.partitionBy(*keys, _B, f"_s_{n}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            near = _over(kind, value, segment)
            out.append(F.when(F.col(f"_s_{n}") == 0, combine(far, near)).otherwise(near).alias(n))
        elif frame == "all":
            out.append(far.alias(n))
        elif frame == "after":
            near = _over(_REVERSED.get(kind, kind), value, back_inside)
            out.append(combine(near, far).alias(n) if kind in ("first", "last") else combine(far, near).alias(n))
        else:
            last = 0 if frame == "upto" else -1
            out.append(combine(far, _over(kind, value, inside.rowsBetween(Window.unboundedPreceding, last))).alias(n))
    kept = [c for c in df.columns if c not in specs]
    return joined.select(*kept, *out)


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: str,
    columns: list[str],
    before: int = 0,
    after: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``prev1..prevN`` and ``next1..nextN``: structs of ``columns`` of nearby rows.

    Rows next to a block border come from the first/last rows of adjacent blocks, which the
    block summary carries (at most ``before``/``after`` rows each).
    """
    return by_length(df, keys, order, lambda rows, step: step.near(rows, columns, before, after), block)


def _near_whole(df: DataFrame, columns: list[str], before: int, after: int, keys: list[str], order: str) -> DataFrame:
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    inside = Window.partitionBy(*keys).orderBy(order)
    back = [F.lag(row, k).over(inside).alias(f"prev{k}") for k in range(1, before + 1)]
    ahead = [F.lead(row, k).over(inside).alias(f"next{k}") for k in range(1, after + 1)]
    return df.select("*", *back, *ahead)


def _near_blocks(df: DataFrame, columns: list[str], before: int, after: int, keys: list[str], order: str, block: int) -> DataFrame:
    df = stage(df)
    row = F.struct(*[F.col(c).alias(c) for c in columns])
    blocked = df.withColumn(_B, F.floor(F.col(order) / F.lit(block)))
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    inside_desc = Window.partitionBy(*keys, _B).orderBy(F.col(order).desc())
    ranked = blocked.select(
        "*", F.row_number().over(inside).alias("_up"), F.row_number().over(inside_desc).alias("_down")
    )
    span = max(before, after)
    edges = (
        ranked.where((F.col("_up") <= after) | (F.col("_down") <= before))
        .groupBy(*keys, _B)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_up") <= after, F.struct(order, row.alias("r"))))).alias("_head"),
            F.sort_array(F.collect_list(F.when(F.col("_down") <= before, F.struct(order, row.alias("r"))))).alias("_tail"),
        )
    )
    by_block = Window.partitionBy(*keys).orderBy(_B)
    summary = edges.select(
        *keys,
        _B,
        F.flatten(F.collect_list("_head").over(by_block.rowsBetween(1, span))).alias("_ahead"),
        F.flatten(F.collect_list("_tail").over(by_block.rowsBetween(-span, -1))).alias("_behind"),
    )
    joined = ranked.join(summary, [*keys, _B])
    out = []
    for k in range(1, before + 1):
        far = F.try_element_at("_behind", (F.col("_up") - F.lit(k + 1)).cast("int"))
        near = F.lag(row, k).over(inside)
        out.append(F.when(F.col("_up") > k, near).otherwise(far["r"]).alias(f"prev{k}"))
    for k in range(1, after + 1):
        far = F.try_element_at("_ahead", (F.lit(k + 1) - F.col("_down")).cast("int"))
        near = F.lead(row, k).over(inside)
        out.append(F.when(F.col("_down") > k, near).otherwise(far["r"]).alias(f"next{k}"))
    return joined.select(*df.columns, *out)


def range_join(
    rows: DataFrame, ranges: DataFrame, keys: list[str], order: str, start: str, end: str, block: int = BLOCK
) -> DataFrame:
    """Rows whose position lies in ``[start, end)`` of a range with the same keys.

    Each range is spread over the blocks it touches, so this is an equi-join on
    ``(keys, block)`` with a bounded number of rows per key.
    """
    spread = ranges.withColumn(
        _B,
        F.explode(
            F.sequence(
                F.floor(F.col(start) / F.lit(block)),
                F.floor((F.greatest(F.col(end) - 1, F.col(start))) / F.lit(block)),
            )
        ),
    )
    blocked = rows.withColumn(_B, F.floor(F.col(order) / F.lit(block)))
    inside = (F.col(order) >= F.col(start)) & (F.col(order) < F.col(end))
    return blocked.join(spread, [*keys, _B]).where(inside).drop(_B)


def successor(
    starts: DataFrame,
    stops: DataFrame,
    keys: list[str],
    start: str,
    at: str,
    kinds: Sequence[str] = (),
    ends: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(keys…, start, at)``: for each start the first later stop that ``ends`` it; starts without one are absent.

    ``ends`` compares columns of a start with the ``kinds`` of a stop. Stops are reduced before
    anything is joined: blocks after the start's own are searched by their first stop of each kind,
    an aggregate that combines map-side, and only the start's own block is searched stop by stop, joined on
    ``(keys, block)``. Stops of a document are thus never brought together.
    """
    ends = F.lit(True) if ends is None else ends
    own = starts.withColumn(_B, F.floor(F.col(start) / F.lit(block)))
    there = F.floor(F.col(at) / F.lit(block))
    firsts = stops.groupBy(*keys, there.alias("_there"), *kinds).agg(F.min(at).alias(at))
    far = own.join(firsts, keys).where((F.col("_there") > F.col(_B)) & ends)
    near = own.join(stops.select(*keys, at, *kinds, there.alias(_B)), [*keys, _B]).where((F.col(at) > F.col(start)) & ends)
    hits = far.select(*keys, start, at).unionByName(near.select(*keys, start, at))
    return hits.groupBy(*keys, start).agg(F.min(at).alias(at))


def automaton(
    df: DataFrame,
    keys: list[str],
    order: str,
    letter: Column,
    states: int,
    step: Callable[[Column, Column], Column],
    flag: Callable[[Column, Column], Column],
    out: str,
    block: int = BLOCK,
) -> DataFrame:
    """``(keys…, order, out)``: rows at which ``flag(state, letter)`` holds, where an automaton of a few states (0 at the start)
    reads a document's letters in order and ``step(state, letter)`` is its next state.

    A block of letters is a function from the state before it to the state after it. Only documents
    of several blocks need it: their blocks' functions, ``states`` small numbers each, are applied one after the
    other, and then every block is read from its own state. At most ``block`` letters are in one row.
    """
    row = F.struct(F.col(order).alias("at"), letter.alias("letter"))
    blocks = stage(df.groupBy(*keys, F.floor(F.col(order) / F.lit(block)).alias(_B)).agg(F.sort_array(F.collect_list(row)).alias("_rows")))
    several = blocks.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    after = lambda state: F.aggregate("_rows", state, lambda s, r: step(s, r["letter"]))
    to = F.array(*[after(F.lit(s)) for s in range(states)])
    parts = blocks.join(several, keys, "left_semi").select(*keys, F.struct(F.col(_B), to.alias("to")).alias("_part"))
    listed = parts.groupBy(*keys).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    begun = F.aggregate(
        "_parts", F.array(F.lit(0)), lambda seen, p: F.concat(seen, F.array(F.get(p["to"], F.element_at(seen, -1))))
    )
    entered = listed.select(*keys, F.explode(F.arrays_zip(F.col("_parts").alias("p"), begun.alias("s"))).alias("_e")).where("_e.p is not null")
    entered = entered.select(*keys, F.col(f"_e.p.{_B}").alias(_B), F.col("_e.s").alias("_state"))
    start = F.struct(F.coalesce("_state", F.lit(0)).alias("state"), F.lit("").alias("flags"))
    read = F.aggregate(
        "_rows",
        start,
        lambda acc, r: F.struct(
            step(acc["state"], r["letter"]).alias("state"),
            F.concat(acc["flags"], F.when(flag(acc["state"], r["letter"]), "1").otherwise("0")).alias("flags"),
        ),
    )
    flags = blocks.join(entered, [*keys, _B], "left").select(*keys, "_rows", F.split(read["flags"], "").alias("_f"))
    marked = flags.select(*keys, F.explode(F.filter(F.arrays_zip("_rows", "_f"), lambda z: z["_f"] == "1")).alias("_z"))
    return marked.select(*keys, F.col("_z._rows.at").alias(order), F.lit(True).alias(out))


def _automaton_whole(
    df: DataFrame, letter: Column, states: int, step: Callable[[Column, Column], Column], flag: Callable[[Column, Column], Column], out: str,
    rest: str, keys: list[str], order: str,
) -> DataFrame:
    """``df`` with ``out``, in the order it is in. A document's letters other than ``rest`` are gathered in a window; its first row
    reads them, and the positions of flags are handed on to the others, so that the rows are neither grouped nor joined."""
    inside = Window.partitionBy(*keys).orderBy(order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = df.select("*", letter.alias("_l")).select("*", F.row_number().over(inside).alias("_n"))
    listed = numbered.select("*", F.collect_list(F.when(F.col("_l") != rest, F.struct("_n", "_l"))).over(whole).alias("_ls"))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def read(acc: Column, r: Column) -> Column:
        before = F.when(r["_n"] == acc["n"] + 1, acc["state"]).otherwise(0)
        return F.struct(
            step(before, r["_l"]).alias("state"), r["_n"].alias("n"), F.when(flag(before, r["_l"]), F.array_append(acc["at"], r["_n"])).otherwise(acc["at"]).alias("at")
        )

    first = listed.withColumn("_at", F.when((F.col("_n") == 1) & (F.size("_ls") > 0), F.aggregate("_ls", start, read, lambda acc: acc["at"]))).drop("_ls")
    shared = first.select("*", F.first("_at").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_hits"))
    return shared.select(*df.columns, F.coalesce(F.array_contains("_hits", F.col("_n")), F.lit(False)).alias(out))


def _automaton_blocks(
    df: DataFrame, letter: Column, states: int, step: Callable[[Column, Column], Column], flag: Callable[[Column, Column], Column], out: str,
    rest: str, keys: list[str], order: str, block: int,
) -> DataFrame:
    df = stage(df)
    hits = automaton(df, keys, order, letter, states, step, flag, out, block)
    return df.join(hits, [*keys, order], "left").select(*df.columns, F.coalesce(out, F.lit(False)).alias(out))
