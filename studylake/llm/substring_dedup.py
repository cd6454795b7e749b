"""Removal of passages that an earlier document has: every window of ``WINDOW`` words that starts in a document with a smaller doc_id.

Super-k-mers: a window's minimiser is the least hash among its runs of ``M`` words. Consecutive windows of a document that share it make one
run, which travels as one packed string (its words joined by one space) to the minimiser's bucket, so a word is sent about three times
and not fifty. Equal windows have equal minimisers, hence equal windows meet. In a bucket the windows of its strings are sorted, equal ones
are compared word by word, and each gets the smallest doc_id among its equals.

What travels is narrowed first. Runs are counted without their text (doc_id, place, length, minimiser); only minimisers of at least two
different documents can repeat a window, and only documents with such runs are read again, and only those runs are packed. Equal
strings become one before the buckets, by an aggregate that combines before the shuffle, so a crowd of exact copies costs a bucket one string; answers go back
to a string's places through its two 64-bit hashes. A bucket of more than ``HOT`` different strings (a passage in very many contexts) is not
sorted by one task: its windows are spread by two 64-bit hashes of their words, and their smallest doc_id is an aggregate too.

Limits that lose nothing: a run of more than ``RUN`` windows is cut into runs, since windows are compared one by one; a word of more than
``LONG`` bytes is packed as its 128-bit digest.

Defined cases: a null, empty or blank text has no words; texts of fewer than ``WINDOW`` words lose none; rows without a doc_id take no part, they are
neither changed nor a source; rows that share a doc_id do not clear each other, since neither is smaller; windows are judged on the
input; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm import shingles
from studylake.llm.common import named, store
from studylake.llm.shingles import shingle_hashes, slices

WINDOW, M, RUN, LONG, HOT = 50, 8, 256, 64, 1000
SLICE = 1 << 20
CHUNK = 1 << 21  # bytes of packed strings sorted at once, and what is left of the last bucket

_SPACES = bytes(32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
RUNS = "doc_id long, key long, start int, n int, mini long"
PIECES = "doc_id long, key long, start int, mini long, packed binary"
FIRSTS = "a long, b long, low int, high int, first long"


def words(text: str | None) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w] if text else []


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values."""
    out, reach = h, 1
    while reach < span:
        step = min(reach, span - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
        w = shingles.words(batch.column("text"))
        n = max(0, len(w.hash) - WINDOW + 1)
        least = _least(shingle_hashes(w.hash, M), WINDOW - M + 1)[:n]
        doc = np.searchsorted(w.first, np.arange(n), "right") - 1
        at = np.flatnonzero(np.arange(n) + WINDOW <= w.first[doc + 1])  # windows inside one text
        doc, least = doc[at], least[at]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(place % RUN == 0)
        size = np.diff(np.append(begin, len(at)))
        rows = pa.array(doc[begin])
        start = at[begin] - w.first[doc[begin]]
        columns = [batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(least[begin].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "start", "n", "mini"])


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, key, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "runs")), strict=True):
            found = words(text)
            if max(map(len, found)) > LONG:
                found = [b"\t" + blake2b(w, digest_size=16).hexdigest().encode() if len(w) > LONG else w for w in found]
            for r in runs:
                packed = b" ".join(found[r["start"] : r["start"] + r["n"] + WINDOW - 1])
                for column, value in zip(out, (doc_id, key, r["start"], r["mini"], packed), strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "key", "start", "mini", "packed"])


def _rolling(ids: np.ndarray) -> np.ndarray:
    """A hash of every ``WINDOW`` consecutive ids, by doubling."""
    power, size, part = np.array([0x9E3779B97F4A7C15], np.uint64), 1, ids.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    left = WINDOW
    while left:
        if left & 1:
            out = part if out is None else out[: len(part) - done] * power + part[done:]
            done += size
        left >>= 1
        if left:
            part = part[: len(part) - size] * power + part[size:]
            power, size = power * power, size * 2
    return out


def smallest(packed: pa.Array, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the strings: string, place in it, smallest ``least`` among the strings that have an equal window."""
    split = pc.split_pattern(packed.cast(pa.large_binary()), b" ")
    ids = split.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = split.offsets.to_numpy()
    first = first - first[0]
    n = first[1:] - first[:-1] - WINDOW + 1
    string = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = first[string] + place
    h = _rolling(ids)[at]
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    near = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    same = np.ones(len(near), bool)
    for k in range(WINDOW):  # equal hashes are compared word by word
        same &= ids[at[order[near]] + k] == ids[at[order[near - 1]] + k]
    if not same.all():  # different windows of one hash lie between each other: sort by the words themselves
        order = np.lexsort([ids[at + k] for k in range(WINDOW - 1, -1, -1)])
        near, same = np.arange(1, len(order)), np.ones(len(order) - 1, bool)
        for k in range(WINDOW):
            same &= ids[at[order[1:]] + k] == ids[at[order[:-1]] + k]
    new[near[same]] = False
    begin = np.flatnonzero(new)
    lowest = np.minimum.reduceat(least[string[order]], begin)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(lowest, np.diff(np.append(begin, len(order))))
    return string, place, out


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimiser, to the smallest doc_id of each window, as runs of one value."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in (part for whole in batches for part in slices(whole, "packed", SLICE)):
        held.append(batch)
        size += batch.column("packed").nbytes
        if size < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        mini = table.column("mini").to_numpy()
        others = np.flatnonzero(mini != mini[-1])  # whole buckets
        if len(others):
            cut = int(others[-1]) + 1
            yield from _sorted(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.column("packed").nbytes for b in held)
    if held:
        yield from _sorted(pa.Table.from_batches(held))


def _sorted(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    if not len(table):
        return
    a, b, least, most = (table.column(c).to_numpy() for c in ("a", "b", "least", "most"))
    string, place, first = smallest(table.column("packed").chunk(0), least)
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (first[1:] != first[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(string)) - 1
    some = first[low] < most[string[low]]  # else no document with this string is later
    low, high = low[some], high[some]
    columns = [pa.array(a[string[low]]), pa.array(b[string[low]]), pa.array(place[low], pa.int32()), pa.array(place[high], pa.int32()), pa.array(first[low])]
    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "low", "high", "first"])


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of large buckets to their windows, as hashes."""
    for batch in (part for whole in batches for part in slices(whole, "packed", SLICE)):
        row, place, h = [], [], []
        for i, packed in enumerate(batch.column("packed").to_pylist()):
            found = packed.split(b" ")
            for k in range(len(found) - WINDOW + 1):
                row.append(i)
                place.append(k)
                h.append(blake2b(b" ".join(found[k : k + WINDOW]), digest_size=16).digest())
        both = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
        rows = pa.array(row, pa.int64())
        columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("a").take(rows), batch.column("b").take(rows), pa.array(place, pa.int32()), batch.column("least").take(rows), batch.column("most").take(rows)]
        yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "a", "b", "place", "least", "most"])


def cleared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
        out: tuple[list, ...] = ([], [], [], [])
        for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
            found = words(text)
            kept = found
            if spans:
                gone = np.zeros(len(found) + 1, np.int64)
                np.add.at(gone, [s["low"] for s in spans], 1)
                np.add.at(gone, [s["high"] for s in spans], -1)
                kept = [found[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            for column, value in zip(out, (doc_id, len(found), len(found) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.large_string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_words", "n_removed", "text"])


def repeated(docs: DataFrame) -> DataFrame:
    """Words that earlier documents' windows cover: doc_id, key (hash of the text), spans (of words: low, high exclusive), of ``docs`` (doc_id, key, text)."""
    runs = store(docs.filter("doc_id is not null").mapInArrow(run_rows, RUNS)).df
    shared = named(runs.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mini"))
    marked = runs.join(shared, "mini").groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "mini")).alias("runs"))
    pieces = docs.join(marked, ["doc_id", "key"]).select("doc_id", "key", "text", "runs").mapInArrow(piece_rows, PIECES)
    pieces = store(pieces.withColumns({"a": F.xxhash64("packed"), "b": F.xxhash64(F.lit(1), "packed")})).df

    strings = store(pieces.groupBy("mini", "packed", "a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))).df
    large = named(strings.groupBy("mini").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("mini"))
    small = strings.join(large, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini")
    found = small.mapInArrow(bucket_rows, FIRSTS)
    kind = "x long, y long, a long, b long, place int, least long, most long"
    spread = store(strings.join(large, "mini", "left_semi").mapInArrow(window_rows, kind)).df
    firsts = spread.groupBy("x", "y").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first < last").select("x", "y", "first")
    apart = spread.join(firsts, ["x", "y"]).filter("first < most").select("a", "b", F.col("place").alias("low"), F.col("place").alias("high"), "first")

    answers = named(found.unionByName(apart))
    spans = pieces.select("doc_id", "key", "start", "a", "b").join(answers, ["a", "b"]).filter("first < doc_id")
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + WINDOW).alias("high"))
    return spans.groupBy("doc_id", "key").agg(F.collect_set(span).alias("spans"))


def drop_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without the words of windows that an earlier document has: doc_id, n_words, n_removed, text (kept words joined by one space)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    spans = store(repeated(keyed)).df
    rows = keyed.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cleared_rows, "doc_id long, n_words long, n_removed long, text string")
