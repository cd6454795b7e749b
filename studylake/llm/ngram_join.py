"""Exact Jaccard join on word shingles, with set-relation skipping, and its link components.

Two sets link when 100 * intersection >= PERCENT * union, so a set of n members can miss at most
n - ceil(t n) of them in a partner. All steps are exact; none depends on a group's size.

1. Equal sets are one class (128-bit digest); copies are never paired.
2. Sharing filter. Of each set only the hashes under a threshold f(n) are looked at, a larger part for smaller sets.
   A set with a partner shares all but n - ceil(t n) of them with some other set. Batches send each hash once, packed by
   hash range; a hash that two sets of a batch have is known to be shared there and is sent as one mark. Range tasks
   answer with counts, one row for a batch, which are added up by batch. Most texts end here.
3. Index lists of the survivors. A list's key is (size band, hash). Members are ordered by frequency, then hash; only
   the prefix that must meet a partner is indexed, with its position.
4. Answers from similar sets. Every member of a list is compared with the list's leader only. Members that link to it
   have one answer as far as components go, so pairs inside a component are never compared again.
5. Block skipping. Lists that hold one component are skipped whole. Texts of the others get a second index, of their whole sets:
   step 3 sees a part of a set, in which a text of a crowd has only a part of the hashes that are its own, so that its prefix
   reaches what the whole crowd shares; among all its hashes those of its own come first and mostly fill the prefix. Only pairs
   of different components are compared, if their sizes and their positions in a list leave them enough room. No pair that
   could link two components is left out: two texts that link meet in a list of step 3, and in a list of their whole sets.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a row without doc_id gets its
set's size and a null component and links with nothing; equal rows are equal sets; rows that share a doc_id are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from studylake.llm.common import Stored, named, partitions_of, store, tidy, without
from studylake.llm.components import components
from studylake.llm.shingles import K, slices, text_shingles, words

PERCENT = 80
_ALL = float(1 << 64)
_MARK, _SILENT = np.uint32((1 << 32) - 1), np.uint32((1 << 32) - 2)


FILTER, INDEX = (0.25, 16), (0.3, 128)  # share of the hash space that sets of n members look at: a + b / n, falls with n


def _under(u: np.ndarray, n: float, look: tuple[float, int]) -> int:
    """How many of the sorted hashes are looked at by sets of n."""
    part = look[0] + look[1] / max(n, 1)
    return len(u) if part >= 1 else int(np.searchsorted(u, np.uint64(int(part * _ALL))))


def digest(u: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("batch", pa.int64()), ("at", pa.int64()),
     ("looked", pa.int64()), ("known", pa.int64()), ("range", pa.int32()), ("data", pa.binary())]
)


def set_rows(ranges: int, k: int, percent: int):
    """Per batch: one row for each text (range is null) and one for each hash range (data: hashes, then owners).

    The part that all sets look at has three quarters of the ranges."""
    low = ranges * 3 // 4
    edges = np.concatenate((np.arange(1, low) * (FILTER[0] / low), np.linspace(FILTER[0], 1, ranges - low, endpoint=False)))
    edges = (edges * _ALL).astype(np.uint64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text"):
                number += 1
                yield from one(batch, number)

    def one(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        at, n, ids, sent, looked = [], [], [], [], []
        for u in text_shingles(words(batch.column("text")), k):
            c = digest(u)
            n.append(len(u))
            ids.append(c)
            if c not in seen:
                seen[c] = len(seen)
                sent.append(u[: _under(u, len(u), FILTER)])
                looked.append(_under(u, len(u) * 100 / percent + 1, FILTER))
            at.append(seen[c])
        owner = np.repeat(np.arange(len(sent), dtype=np.uint32), [len(s) for s in sent])
        counted = np.concatenate([np.arange(len(s)) < m for s, m in zip(sent, looked, strict=True)] or [np.empty(0, bool)])
        h = np.concatenate(sent or [np.empty(0, np.uint64)])
        order = np.argsort(h)
        h, owner, counted = h[order], owner[order], counted[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
        run = np.cumsum(new) - 1
        several = (np.bincount(run) > 1)[run] if len(h) else new
        known = np.bincount(owner[several & counted], minlength=len(sent))
        # a mark says that two sets of this batch have the hash; one that only partners look at needs no answer
        owner = np.where(several, _MARK, np.where(counted, owner, _SILENT))[new]
        h = h[new]
        bounds = np.searchsorted(h, edges)
        size = len(at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([c[0] for c in ids], pa.int64()), pa.array([c[1] for c in ids], pa.int64()),
             pa.array([number] * size, pa.int64()), pa.array(at, pa.int64()), pa.array([looked[a] for a in at], pa.int64()),
             pa.array([int(known[a]) for a in at], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
            schema=SETS,
        )
        data = [a.astype("<u8").tobytes() + b.astype("<u4").tobytes() for a, b in zip(np.split(h, bounds), np.split(owner, bounds), strict=True)]
        full = [i for i, d in enumerate(data) if d]
        size = len(full)
        nothing = pa.nulls(size, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, nothing, pa.array([number] * size, pa.int64()), nothing, nothing, nothing, pa.array(full, pa.int32()), pa.array([data[i] for i in full], pa.binary())],
            schema=SETS,
        )

    return rows


def shared_counts(parts: pa.Table) -> pa.Table:
    """Of one hash range: how many of the hashes each set sent are in another set, too; one row a batch (data: sets, then counts)."""
    hashes, owners, batches = [], [], []
    for number, data in zip(parts.column("batch").to_pylist(), parts.column("data").to_pylist(), strict=True):
        n = len(data) // 12
        hashes.append(np.frombuffer(data, "<u8", n))
        owners.append(np.frombuffer(data, "<u4", n, 8 * n))
        batches.append(np.full(n, number))
    h, owner, number = np.concatenate(hashes), np.concatenate(owners), np.concatenate(batches)
    order = np.argsort(h, kind="stable")
    h, owner, number = h[order], owner[order], number[order]
    run = np.cumsum(np.concatenate(([True], h[1:] != h[:-1]))) - 1
    marked = np.zeros(run[-1] + 1, bool)
    marked[run[owner == _MARK]] = True
    shared = ((np.bincount(run) > 1) | marked)[run] & (owner < _SILENT)
    keys, counts = np.unique(np.stack((number[shared], owner[shared].astype(np.int64))), axis=1, return_counts=True)
    of = np.flatnonzero(np.concatenate(([True], keys[0, 1:] != keys[0, :-1]))) if len(counts) else np.empty(0, int)
    parts_of = zip(np.split(keys[1], of[1:]), np.split(counts, of[1:]), strict=True) if len(counts) else ()
    data = [at.astype("<u4").tobytes() + n.astype("<u4").tobytes() for at, n in parts_of]
    return pa.table({"batch": pa.array(keys[0, of], pa.int64()), "data": pa.array(data, pa.binary())})


def total_counts(parts: pa.Table) -> pa.Table:
    """Of one batch: the counts of each of its sets over all ranges; sets without any are absent."""
    at, n = [], []
    for data in parts.column("data").to_pylist():
        both = np.frombuffer(data, "<u4")
        at.append(both[: len(both) // 2])
        n.append(both[len(both) // 2 :])
    total = np.bincount(np.concatenate(at), np.concatenate(n)).astype(np.int64)
    found = np.flatnonzero(total)
    batch = parts.column("batch")[0].as_py()
    return pa.table({"batch": pa.array(np.full(len(found), batch)), "at": pa.array(found), "cnt": pa.array(total[found])})


def set_members(k: int):
    """The sorted hashes of each text, where its class is the row's."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = list(text_shingles(words(batch.column("text")), k))
                same = [digest(u) == (a, b) for u, a, b in zip(sets, batch.column("c1").to_pylist(), batch.column("c2").to_pylist(), strict=True)]
                kept = [i for i, s in enumerate(same) if s]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(kept, pa.int64())), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([sets[i].tobytes() for i in kept], pa.binary())],
                    names=["doc", "n", "members"],
                )

    return rows


def band(n: float, percent: int) -> int:
    return int(np.floor(np.log(max(n, 1)) / np.log(100 / percent) + 1e-9))


def _looked(u: np.ndarray, key: int, percent: int) -> int:
    """How many of its hashes a set indexes under a band key: as many as the largest set under that key does."""
    return _under(u, (100 / percent) ** (key + 1) + 1, INDEX)


def thin_bands(percent: int):
    """Band keys under which some set would not look at more hashes than a partner may lack."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("members").to_pylist(), strict=True):
                u, b = np.frombuffer(data, np.uint64), band(n, percent)
                found |= {key for key in (b, b + 1) if (m := _looked(u, key, percent)) < n and m <= n - -(-n * percent // 100)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["band"])

    return rows


def index_entries(percent: int, whole: set[int]):
    """Looked-at hashes of each set under the two size bands it is a member of. Sets that can link are in the same
    or in neighbouring bands, so they have a band key in common; all sets under a key look at the same part of the
    hashes, at all under the keys in ``whole``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "members")), strict=True):
                u, b = np.frombuffer(data, np.uint64), band(n, percent)
                for key in (b, b + 1):
                    m = n if key in whole else _looked(u, key, percent)
                    parts.append((np.full(m, key, np.int32), u[:m].view(np.int64), np.full(m, doc), np.full(m, n), np.full(m, m)))
                    size += m
                if size > 200_000:
                    yield _together(parts, ["band", "h", "doc", "n", "looked"])
                    parts, size = [], 0
            if parts:
                yield _together(parts, ["band", "h", "doc", "n", "looked"])

    return rows


def _together(parts: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=names)


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a, b, strict=True)
    return pa.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in pairs], pa.int64())


def _missing(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100)


def _room(percent: int) -> Column:
    """Whether list members x and y can link if this list's hash is the first that they have in common: what stands before it in
    one is not in the other, and what stands behind it must reach the overlap that their sizes ask for."""
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    spare = lambda s: F.col(f"{s}.n") - overlap
    left = lambda s: F.col(f"{s}.looked") - F.col(f"{s}.pos") + 1
    before = (F.col("x.pos") - 1 <= spare("x")) & (F.col("y.pos") - 1 <= spare("y"))
    return before & (left("y") >= F.col("x.looked") - spare("x")) & (left("x") >= F.col("y.looked") - spare("y"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", _common("ma", "mb"))
    return both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def whole_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All hashes of each set."""
    for batch in batches:
        parts, size = [], 0
        for doc, n, root, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "root", "members")), strict=True):
            parts.append((np.frombuffer(data, np.int64), np.full(n, doc), np.full(n, n), np.full(n, root)))
            size += n
            if size > 200_000:
                yield _together(parts, ["h", "doc", "n", "root"])
                parts, size = [], 0
        if parts:
            yield _together(parts, ["h", "doc", "n", "root"])


def whole_lists(sets: DataFrame, still: DataFrame, percent: int) -> Stored:
    """Index lists over the whole sets of the texts ``still`` (doc, root)."""
    entries = store(sets.join(still, "doc").mapInArrow(whole_entries, "h long, doc long, n long, root long"))
    seen = entries.df.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    lists = store(_prefixes(entries.df.withColumn("looked", F.col("n")), seen, ["h"], [], percent))
    entries.drop()
    return lists


def _prefixes(entries: DataFrame, seen: DataFrame, key: list[str], per: list[str], percent: int) -> DataFrame:
    """Of each set the entries that must meet a partner, with their position (pos). Hashes are ordered by how many sets have
    them (``seen``: key, df), then by hash; those that no other set has come first. ``per``: what orders are kept apart by."""
    own = Window.partitionBy(*per, "doc")
    found = entries.join(seen, key).withColumn("shared", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "h")))
    pos = F.col("rank") + F.col("looked") - F.col("shared")
    return found.withColumn("pos", pos).filter(F.col("pos") <= _missing(F.col("n"), percent) + 1).drop("df", "shared", "rank")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links between different sets (doc, n, members), enough for all components: a, b."""
    whole = {r.band for r in sets.mapInArrow(thin_bands(percent), "band int").distinct().collect()}  # a few dozen bands at most
    entries = store(sets.mapInArrow(index_entries(percent, whole), "band int, h long, doc long, n long, looked long"))
    seen = entries.df.groupBy("band", "h").agg(F.count("*").alias("df")).filter("df > 1")
    lists = store(_prefixes(entries.df, seen, ["band", "h"], ["band"], percent))
    entries.drop()

    leaders = lists.df.groupBy("band", "h").agg(F.min(F.struct("doc", "n", "pos", "looked")).alias("y")).select("band", "h", "y.*")
    stars = lists.df.alias("x").join(leaders.alias("y"), ["band", "h"]).filter((F.col("y.doc") < F.col("x.doc")) & _room(percent))
    stars = stars.select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b")).distinct()
    first = store(verified(stars, sets, percent))
    roots = store(components(first.df))

    rooted = lists.df.join(roots.df.select(F.col("node").alias("doc"), "root"), "doc", "left")
    rooted = store(rooted.select("band", "h", "doc", F.coalesce("root", "doc").alias("root")))
    for s in (lists, roots):
        s.drop()
    mixed = rooted.df.groupBy("band", "h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band", "h")
    still = store(rooted.df.join(mixed, ["band", "h"], "left_semi").select("doc", "root").distinct())
    rooted.drop()
    lists = whole_lists(sets, still.df, percent)
    x, y = lists.df.alias("x"), lists.df.alias("y")
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root")) & _room(percent))
    rest = rest.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    second = store(verified(rest, sets, percent))
    for s in (still, lists):
        s.drop()
    return first.df.unionByName(second.df)


def link_components(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), and class_id (smallest doc_id
    with the same set) per row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = 4 * partitions_of(docs)
    sent = store(docs.mapInArrow(tidy(set_rows(ranges, k, percent)), "doc_id long, n long, c1 long, c2 long, batch long, at long, looked long, known long, range int, data binary"))
    rows = sent.df.filter("range is null").drop("range", "data")
    answers = sent.df.filter("range is not null").select("range", "batch", "data").groupBy("range").applyInArrow(lambda t: shared_counts(t), "batch long, data binary")
    answers = answers.groupBy("batch").applyInArrow(lambda t: total_counts(t), "batch long, at long, cnt long")
    sharing = F.col("known") + F.coalesce("cnt", F.lit(0)) >= F.greatest(F.lit(0), F.col("looked") - _missing(F.col("n"), percent))
    classes = rows.filter("n > 0 and doc_id is not null").join(answers, ["batch", "at"], "left")
    classes = store(classes.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.max(sharing).alias("sharing")))
    counted = store(rows.select("doc_id", "n", "c1", "c2"))
    sent.drop()

    wanted = named(classes.df.filter("sharing").select(F.col("doc").alias("doc_id"), "c1", "c2"))
    sets = store(docs.join(wanted, "doc_id").mapInArrow(tidy(set_members(k)), "doc long, n long, members binary"))
    links = class_links(sets.df.dropDuplicates(["doc", "members"]), percent)
    # rows that share a doc_id tie their classes together
    tied = counted.df.filter("n > 0 and doc_id is not null").join(classes.df.select("c1", "c2", "doc"), ["c1", "c2"]).filter("doc_id <> doc")
    repeated = counted.df.filter("n > 0").groupBy("doc_id").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi")).filter("lo <> hi").select("doc_id")
    tied = tied.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    roots = components(links.unionByName(tied))
    sets.drop()
    placed = classes.df.select("c1", "c2", "doc").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("c1", "c2", "doc", F.coalesce("root", "doc").alias("root"))
    out = counted.df.join(placed, ["c1", "c2"], "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root"))).otherwise(F.col("doc_id"))
    same = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("doc"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), same.alias("class_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """``docs`` without the members of a component other than its smallest doc_id; all columns stay. Of rows that share that
    doc_id all stay. Rows without doc_id stay."""
    return without(docs, link_components(docs, percent, k).filter("component_id <> doc_id").select("doc_id"))
