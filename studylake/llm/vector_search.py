"""Approximate nearest neighbours by inner product with multi-index hashing.

Vectors are brought to one length by an added component (the largest norm's rest), so that angles order inner products.
A rotation learned on a bounded sample (principal axes, then iterative quantization) turns them into ``BITS`` sign bits.
A code is split into ``PARTS`` substrings, each with its own index. Codes within Hamming radius r agree with the query's in some
substring up to r // PARTS bits, so probing the substrings' values up to that distance retrieves every code within r; where the
ball of probes is over 1/16 of the index, the values of the index are compared instead and spread over all codes of the block,
which retrieves the same as a plain scan does, at its cost. What is within r is ranked by the inner product of the original vectors in double precision.

r is learned, too: on the sample it holds ``RECALL`` of the true neighbours. Full tables have nearer neighbours than a sample,
so recall rises with size. A query that finds fewer than k is searched again with a radius that holds all codes.

Every row is indexed. Rows are dealt evenly by a hash of their id into blocks, queries into blocks, and each pair of blocks is a
task with its own index; a task returns k rows a query. No block depends on how rows cluster, so equal vectors are no
hot group.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no
part, nor do rows without id; of rows with one id the smallest vector counts; ties go to the smaller id; fewer than k others
give fewer rows; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studylake.llm.common import store

K = 20
BITS, PARTS = 64, 4
RECALL = 0.98
SAMPLE = 20_000  # rows that rotation and radius are fitted on, by hash order of their ids
BLOCK, QUERY_BLOCK = 16_384, 2_048
PROBE = 16  # a probe costs as much as so many compared values
BALL = np.arange(1 << 16, dtype=np.uint16)
BALL = BALL[np.argsort(np.bitwise_count(BALL), kind="stable")]  # substrings by their number of bits
BALL_SIZES = np.cumsum(np.bincount(np.bitwise_count(BALL), minlength=17))  # how many have up to so many


def usable(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, embedding) that take part, one per id."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select("vec_id", "embedding").filter(fine & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("embedding") == (lengths.n if lengths else 0))


def lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))
    return np.column_stack((x, rest))


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30) -> np.ndarray:
    """Columns that turn rows of ``x`` into ``bits`` values whose signs lose least. Fewer components than bits are spread
    by several random rotations of the principal axes."""
    rng, out = np.random.default_rng(4), []
    _, _, axes = np.linalg.svd(x.T @ x)
    while sum(a.shape[1] for a in out) < bits:
        k = min(bits, x.shape[1], bits - sum(a.shape[1] for a in out))
        basis = axes[:k].T
        y, r = x @ basis, np.linalg.qr(rng.normal(size=(k, k)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ w).T
        out.append(basis @ r)
    return np.column_stack(out)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def learn_radius(x: np.ndarray, code: np.ndarray, asked: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Smallest radius round the codes of queries (``asked``) that holds ``recall`` of the true k neighbours among the sample."""
    distances = []
    for q in range(min(queries, len(x))):
        scores = x @ x[q]
        scores[q] = -np.inf
        near = top(scores, np.arange(len(x)), min(k, len(x) - 1))
        distances.append(np.bitwise_count(code[near] ^ asked[q]))
    found = np.concatenate(distances or [np.zeros(0)])
    return int(np.quantile(found, recall, method="higher")) if len(found) else BITS


class MultiIndex:
    """Substring indexes of a block of codes: places sorted by a substring's value, and where each value's places begin."""

    def __init__(self, code: np.ndarray, parts: int):
        self.code, self.parts = code, parts
        self.pieces = code.view(np.uint16).reshape(len(code), BITS // 16)[:, :parts]
        self.places = [np.argsort(self.pieces[:, j], kind="stable") for j in range(parts)]
        self.values, self.where = zip(*(np.unique(self.pieces[:, j], return_inverse=True) for j in range(parts)), strict=True)
        self.begins = [np.concatenate([[0], np.cumsum(np.bincount(self.pieces[:, j], minlength=1 << 16))]) for j in range(parts)]

    def probes(self, part: int, value: np.ndarray, each: int) -> np.ndarray | None:
        """Values within ``each`` bits of ``value``; None where they are so many that comparing the index's values costs less."""
        size = BALL_SIZES[min(each, 16)]
        return value ^ BALL[:size] if PROBE * size <= len(self.values[part]) else None

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within ``radius``."""
        each, q = radius // self.parts, query.view(np.uint16)
        probed = np.zeros(len(self.code), bool)
        for j in range(self.parts):
            values = self.probes(j, q[j], each)
            if values is None:
                probed |= (np.bitwise_count(self.values[j] ^ q[j]) <= each)[self.where[j]]
                continue
            values = values.astype(np.int64)
            begins = self.begins[j][values]
            n = self.begins[j][values + 1] - begins
            ends = np.cumsum(n)
            probed[self.places[j][np.arange(n.sum()) + np.repeat(begins - ends + n, n)]] = True
        places = np.flatnonzero(probed)
        return places[np.bitwise_count(self.code[places] ^ query[0]) <= radius]


def search(index: DataFrame, queries: DataFrame, rotation: np.ndarray, norm: float, radius: int, blocks: int, query_blocks: int, k: int) -> DataFrame:
    """The k best within ``radius`` of each query in each block: query_id, vec_id, score."""

    def pair(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, ids = np.stack(rows["embedding"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy()
        q, names = np.stack(queries["embedding"].to_numpy()).astype(np.float64), queries["vec_id"].to_numpy()
        multi = MultiIndex(codes(lengthened(x, norm), rotation), PARTS)
        own = codes(lengthened(q, 0.0), rotation)
        out = []
        for i in range(len(q)):
            near = multi.within(own[i : i + 1], radius)
            near = near[ids[near] != names[i]]
            scores = (x[near] * q[i]).sum(1)
            best = top(scores, ids[near], k)
            out.append((np.full(len(best), names[i]), ids[near][best], scores[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select("vec_id", "embedding", part(blocks, 1).cast("int").alias("b"), every(query_blocks).alias("q"))
    asked = queries.select("vec_id", "embedding", every(blocks).alias("b"), part(query_blocks, 2).cast("int").alias("q"))
    return asked.groupBy("b", "q").cogroup(rows.groupBy("b", "q")).applyInPandas(pair, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, radius: int | None = None) -> DataFrame:
    """The k nearest of ``rows`` (vec_id, embedding) to each of ``queries`` (the same columns): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    index, queries = store(usable(rows)).df, store(usable(queries)).df
    total, asked = index.count(), queries.count()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    norm = float(index.agg(F.max(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))).first()[0]) * (1 + 1e-9)
    sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = np.stack(sample["embedding"].to_numpy()).astype(np.float64)
    rotation = learn_rotation(lengthened(x, norm), BITS)
    if radius is None:
        radius = learn_radius(x, codes(lengthened(x, norm), rotation), codes(lengthened(x, 0.0), rotation), k, RECALL)
    blocks, query_blocks = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    found = store(search(index, queries, rotation, norm, radius, blocks, query_blocks, k)).df
    full = found.groupBy("query_id").count().filter(F.col("count") >= min(k, total - 1)).select(F.col("query_id").alias("vec_id"))
    few = store(queries.join(full, "vec_id", "left_anti")).df
    again = few.count()
    if again:
        more = search(index, few, rotation, norm, BITS, blocks, max(1, -(-again // QUERY_BLOCK)), k)
        found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
