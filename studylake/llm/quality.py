"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of whole texts (shares of kinds of characters, word lengths, repetition, lines) are computed once and stored, a few
hundred bytes a document. They are standardized and mapped to ``FEATURES`` random Fourier features, which approximate a Gaussian
kernel. Each partition of labelled rows sums its normal equations; the sums are added in ``SUMS`` tasks, so the driver
solves one small system and gets ``SUMS`` matrices at most. Fitted scores of labelled rows kept out of the fit are counted in
``BINS`` bins and made monotone by pooling adjacent violators.

All labelled rows outside the held-out fold are used: folds 1-3 of crc32(doc_id) mod 5 fit, fold 4 calibrates. Labels, language,
source and doc_id are no inputs of a score.

Defined cases: null and empty texts have all-zero statistics and get a score; documents without a label are scored only; several
labels of a doc_id are averaged; rows without doc_id are scored and not held out; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import store, tidy, without
from studylake.llm.shingles import slices, words

FEATURES, SUMS, BINS = 256, 16, 1000
RIDGE = 1e-3
THRESHOLD = 0.3
FOLDS = 5

_KIND = np.zeros((10, 256), np.int64)
for _row, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:!?", "#$%&*@^~", "|<>{}[]\\/=+_", "\n", " ", "'\"()-")):
    _KIND[_row, [ord(c) for c in _chars]] = 1
_KIND[9, 128:] = 1


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    w = words(texts)
    arr = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    between = lambda values, at: np.diff(np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))[at])
    share = lambda part, whole: part / np.maximum(whole, 1)
    n = np.diff(w.first)
    length = (w.end - w.start).astype(np.float64)
    first, last = w.data[w.start] if len(w.start) else w.data[:0], w.data[w.end - 1] if len(w.end) else w.data[:0]
    columns = [np.log1p(size), np.log1p(n)]
    columns += [share(between(kind[w.data], offsets), size) for kind in _KIND]
    mean = share(between(length, w.first), n)
    columns += [mean, np.sqrt(np.maximum(0, share(between(length**2, w.first), n) - mean**2)), share(between((length <= 3).astype(np.int64), w.first), n), share(between((length > 20).astype(np.int64), w.first), n)]
    columns += [share(between(_KIND[row][last], w.first), n) for row in (3, 4, 5, 2)] + [share(between(_KIND[0][first], w.first), n)]
    lines = between(_KIND[6][w.data], offsets) + 1
    columns += [np.log1p(share(size, lines)), np.log1p(lines)]
    loops = np.zeros((len(n), 7))
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            h = w.hash[a:b]
            _, count = np.unique(h, return_counts=True)
            p = count / len(h)
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            lag = h[40:] if len(h) > 60 else h[:0]
            loops[i] = (
                len(count) / len(h), len(count) / len(h) ** 0.8, p.max(), -(p * np.log(p)).sum() / np.log(len(h) + 1),
                (h[1:] == h[:-1]).mean() if len(h) > 1 else 0, len(np.unique(pairs)) / len(pairs) if len(pairs) else 1, len(np.unique(lag)) / max(1, len(lag)),
            )
    return np.column_stack([*columns, loops]).astype(np.float64)


def statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibrated: np.ndarray  # score of each bin's middle

    def raw(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        middles = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
        return np.interp(self.raw(x), middles, self.calibrated)


def features(x: np.ndarray) -> np.ndarray:
    """1, the standardized statistics, and their random Fourier features."""
    rng = np.random.default_rng(6)
    x = np.clip(x, -6, 6)
    w, b = rng.normal(size=(x.shape[1], FEATURES)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack((np.ones(len(x)), x, np.sqrt(2 / FEATURES) * np.cos(x @ w + b)))


def _summed(rows: DataFrame, part) -> list[np.ndarray]:
    """Sums of ``part(x, y)`` (equal shapes, flat) over rows (x, y): within partitions, then in ``SUMS`` tasks, then here."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                s = part(_matrix(batch.column("x")), batch.column("y").to_numpy())
                total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for s in batch.column("s").to_pylist():
                total = np.frombuffer(s) if total is None else total + np.frombuffer(s)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return [np.frombuffer(r.s) for r in rows.mapInArrow(within, "s binary").repartition(SUMS).mapInArrow(again, "s binary").collect()]


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Monotone shares of ones by pooling adjacent violators; bins without rows lie between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([ones[i], total[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, t, _, hi = blocks.pop()
            blocks[-1][:] = [blocks[-1][0] + o, blocks[-1][1] + t, blocks[-1][2], hi]
    if not blocks:
        return np.full(len(total), 0.5)
    at = [x for b in blocks for x in (b[2], b[3])]
    return np.interp(np.arange(len(total)), at, [v for b in blocks for v in (b[0] / b[1],) * 2])


def fit(labelled: DataFrame) -> Model | None:
    """A model of ``labelled`` (x, y, fold); None without rows."""
    fitting = labelled.filter("fold < 4").select("x", "y")
    moments = _summed(fitting, lambda x, y: np.concatenate(([len(x)], x.sum(0), (x**2).sum(0))))
    if not moments:
        return None
    n, *rest = sum(moments)
    d = len(rest) // 2
    mean = np.array(rest[:d]) / n
    scale = np.sqrt(np.maximum(np.array(rest[d:]) / n - mean**2, 0))
    scale[scale < 1e-9] = 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = features((x - mean) / scale)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = sum(_summed(fitting, normal))
    m = int((np.sqrt(4 * len(sums) + 1) - 1) / 2)
    weights = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * n * np.eye(m), sums[m * m :])
    model = Model(mean, scale, weights, np.zeros(BINS))

    def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(place, minlength=BINS), np.bincount(place, y, BINS)))

    bins = _summed(labelled.filter("fold = 4").select("x", "y"), counts) or _summed(fitting, counts)
    total = sum(bins)
    return model._replace(calibrated=isotonic(total[:BINS], total[BINS:]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) scored by what ``labels`` (doc_id, quality) teach: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = store(docs.mapInArrow(tidy(statistic_rows), "doc_id long, x binary")).df
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    labelled = known.join(marks, "doc_id").withColumn("fold", fold).filter("fold <> 0").select("x", "y", "fold")
    labelled = store(labelled).df
    model = fit(labelled)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = known.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that are not rejected; all columns stay. Rows that share a doc_id go only if all are rejected; rows without doc_id stay."""
    judged = score(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("good")).filter("good = 0")
    return without(docs, judged.select("doc_id"))
