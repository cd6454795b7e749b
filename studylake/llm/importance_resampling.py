"""Resampling of documents by importance towards a target corpus, on hashed word n-grams.

A table of 256 bytes translates a text's UTF-8: A-Z to a-z, every other ASCII byte but digits and a-z to a space; bytes above
127 stay. Splitting it at white space yields the words. An n-gram's bucket is its CRC-32 modulo the number of buckets; the CRC of
a word is the seed under which " " and the next word extend it, so no n-gram is ever built. A task counts buckets in a Counter and sends it
once, ``buckets`` rows whatever it read; the table of all counts is as small, and the driver holds it.

A document's weight is the sum of its features' gains; its score adds Gumbel noise that depends on seed and doc_id alone, so that
taking the highest scores draws without replacement in proportion to exp(weight / 1000). Ranks come from one sort by
ranges of the score: rows are numbered within their range, and a range's first number is the sum of the counts before it.

Defined cases: a null or empty text has no words, no features and weight 0; a null doc_id is read as an empty one in the noise's seed
and comes first among equal scores; equal rows are ranked one after the other; no documents, or none with enough words, give no
ranks; no target texts make every gain follow from the corpus alone. Other columns of the input play no part and do not come out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.llm.common import store
from studylake.llm.shingles import slices

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SLICE = 1 << 20  # bytes of text in Python objects at once, a longer text alone

_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789") | frozenset(range(128, 256))
TABLE = bytes(b if b in _WORD else 32 for b in bytes(range(256)).lower())


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def features(found: list[bytes]) -> list[int]:
    """CRC-32 of all runs of one to three words, joined by one space."""
    one = list(map(crc32, found))
    more = [b" " + w for w in found[1:]]
    two = list(map(crc32, more, one))
    return [*one, *two, *map(crc32, more[1:], two)]


def buckets(text: str | None, n: int) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature."""
    found = words(text)
    return len(found), np.array(features(found), np.uint32) % np.uint32(n)


def count_rows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            for text in batch.column("text").to_pylist():
                seen, times = np.unique(buckets(text, n)[1], return_counts=True)
                counts.update(dict(zip(seen.tolist(), times.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    return rows


def counts(texts: DataFrame, n: int) -> list[int]:
    """Features of all texts in each bucket; the driver gets at most ``n`` rows."""
    out = [0] * n
    for r in texts.select("text").mapInArrow(count_rows(n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    n, s, t = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def score_rows(gain: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, found = buckets(text, len(gain))
                weight = int(gain[found].sum())
                out.append((doc_id, n, len(found), weight, weight + noise(doc_id, seed)))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows


def scores(docs: DataFrame, target: DataFrame, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Weight and score of each of ``docs`` (doc_id, text) towards ``target`` (text): doc_id, n_words, n_features, weight, score."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(score_rows(gains(counts(docs, n), counts(target, n)), seed), SCORED)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``scores`` with rank: 1, 2, … for the ``percent`` % of the documents of at least ``min_words`` words that have the highest
    scores (ties: smaller doc_id), null for the others."""
    scored = store(scores(docs, target, n, seed)).df
    enough = F.col("n_words") >= min_words
    draw = scored.filter(enough).count() * percent // 100
    by_score = scored.filter(enough).repartitionByRange(F.desc("score"), F.asc("doc_id")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"))
    # numbered by range and row; stored, so that both readers see the same ranges
    numbered = store(by_score.withColumn("at", F.monotonically_increasing_id())).df.withColumn("range", F.shiftright("at", 33))
    before = numbered.groupBy("range").agg(F.count("*").alias("size"))  # one row a range: as many as there are partitions
    before = before.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = numbered.join(before, "range").withColumn("rank", F.when(place <= draw, place))
    return ranked.select(*scored.columns, "rank").unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
