"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. A document contains an item if it has at least ``PERCENT`` of the
item's shingles, so it lacks at most m = n - ceil(t n) of them, and of the item's m + 1 smallest hashes (its MinHash
sketch) it has at least one. Each partition's sketches have the length its largest size asks for, never more than the item.
Unlike banded signatures of whole documents, whose similarity to a short item falls to nothing as documents grow, this
finds every containing document, whatever its length. A document that meets a sketch is a candidate, verified by the
exact texts of its shingles.

Documents are read once and are not shuffled: a task probes their shingles against two bitmaps of fixed size (``BITS``
bits), one of sketch hashes, one of all item hashes, and sends candidates with those shingles only that pass the second.
Bitmaps only save rows; the joins after them are exact, for any number of items.

Defined cases: items with fewer than five words, null or empty ones are no evidence and match nothing; null and empty
documents contain nothing; equal item texts match each; rows that share a doc_id are looked at one by one and give one
row per item with the largest containment; a row without doc_id gives rows without doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import store, tidy, without
from studylake.llm.shingles import K, mix, shingle_hashes, slices, text_shingles, words

PERCENT = 80
BITS = 24  # two bitmaps of 2 MB
SLICE = 1 << 20  # bytes of text whose arrays are held at once, a longer text alone


def size_partition(n: int) -> int:
    """Largest size of the partition of ``n``: powers of two."""
    return 1 << (n - 1).bit_length()


def sketch_length(n: int, percent: int) -> int:
    top = size_partition(n)
    return min(n, top - -(-top * percent // 100) + 1)


def item_rows(percent: int, k: int):
    """Per item: its size, sketch hashes, all hashes, and its shingles as text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words(batch.column("text"))
                out = []
                for i, u in enumerate(text_shingles(w, k)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    if b - a >= k:
                        texts = sorted({_shingle(w, j, k) for j in range(a, b - k + 1)})
                        out.append((batch.column("item_id")[i].as_py(), len(texts), np.sort(mix(u))[: sketch_length(len(u), percent)].view(np.int64), u.view(np.int64), texts))
                ids, n, sketch, h, texts = zip(*out, strict=True) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(h, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.binary()))],
                    names=["item_id", "n", "sketch", "hashes", "shingles"],
                )

    return rows


def _shingle(w, i: int, k: int) -> bytes:
    return b" ".join(w.data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + k)).lower()


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which values the top ``bits`` bits of column h take, eight to a byte. Its size is fixed, the driver gets at most 2^(bits - 6) rows."""
    word = F.shiftrightunsigned("h", 64 - bits + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    rows = hashes.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("m")).collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[[r.w for r in rows]] = [r.m for r in rows]
    return out.view(np.uint8)


def _has(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits at these places."""
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)


def candidate_rows(sketched, every, bits: int, k: int):
    """Documents with a hash in the sketch bitmap: those hashes, and the shingles that pass the bitmap of all hashes."""
    shift = np.uint64(64 - bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                yield one(batch, sketched.value, every.value)

    def one(batch: pa.RecordBatch, in_sketch: np.ndarray, in_items: np.ndarray) -> pa.RecordBatch:
        w = words(batch.column("text"))
        h = shingle_hashes(w.hash, k)
        inside = _has(in_items, h >> shift)
        starts = np.flatnonzero(inside)
        sketch_hash = mix(h[starts])
        hit = _has(in_sketch, sketch_hash >> shift)
        text = np.searchsorted(w.first, starts, "right") - 1
        fits = starts + k <= w.first[text + 1] if len(starts) else hit
        docs, sketches, shingles = [], [], []
        for d in np.unique(text[hit & fits]).tolist():
            lo, hi = np.searchsorted(text, [d, d + 1])
            own = np.arange(lo, hi)[fits[lo:hi]]
            docs.append(d)
            sketches.append(np.unique(sketch_hash[own][hit[own]]).view(np.int64))
            shingles.append(sorted({_shingle(w, i, k) for i in starts[own].tolist()}))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(shingles, pa.list_(pa.binary()))],
            names=["doc_id", "sketch", "shingles"],
        )

    return rows


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = K, bits: int = BITS) -> DataFrame:
    """Items (item_id, text) that documents (doc_id, text) contain: doc_id, item_id, n_item (its shingles), n_found."""
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_rows(percent, k), "item_id long, n long, sketch array<long>, hashes array<long>, shingles array<binary>")
    known = store(known).df
    sketch = known.select("item_id", F.explode("sketch").alias("h"))
    maps = [spark.sparkContext.broadcast(bitmap(x, bits)) for x in (sketch, known.select(F.explode("hashes").alias("h")))]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(tidy(candidate_rows(*maps, bits, k)), "doc_id long, sketch array<long>, shingles array<binary>")
    found = store(found.withColumn("key", F.struct("doc_id", F.xxhash64("shingles").alias("a"), F.xxhash64(F.lit(1), "shingles").alias("b")))).df
    pairs = found.select("key", F.explode("sketch").alias("h")).join(sketch, "h").select("key", "item_id").distinct()
    both = pairs.join(found.select("key", F.col("shingles").alias("have")).dropDuplicates(["key"]), "key")
    both = both.join(known.select("item_id", "n", "shingles"), "item_id").withColumn("n_found", F.size(F.array_intersect("have", "shingles")).cast("long"))
    both = both.filter(F.col("n_found") * 100 >= F.col("n") * percent)
    return both.groupBy(F.col("key.doc_id").alias("doc_id"), "item_id").agg(F.max("n").alias("n_item"), F.max("n_found").alias("n_found"))


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """``docs`` without documents that contain an item; all columns stay. Documents without a doc_id
    stay: they cannot be named."""
    return without(docs, contained_items(docs, items, percent, k).select("doc_id"))
