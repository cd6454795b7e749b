"""Boilerplate lines by their frequency within a site.

A line's ratio is the number of a host's pages that contain it over the number of the host's pages.
Lines over the ratio are dropped wherever that host has them; lines are compared without outer white
space, by two 64-bit hashes.

No text is shuffled to be counted: a page sends each distinct line once, as 16 bytes and its host, and
counts combine before the shuffle, so a line on every page of a host with a third of all rows is a few
rows. Lines on fewer than ``min_pages`` pages go before the host totals are joined: a line of one page
repeats nothing, whatever its share. No other floor stands beside the ratio, so a small host is judged
as a large one is; on a host of few pages two equal pages are enough. What is left has at most (mean
distinct lines per page) / ratio entries per host; it is stored, and its size decides whether
Spark broadcasts it or joins by host, where a hot host is split.

Only built-in column functions are used.

Defined cases: a null text gives a null text and no lines; a null host is a host of its own; blank lines
are no boilerplate and stay; a page with the same line twice counts once and loses both; equal rows are
separate pages. A text that is all boilerplate becomes empty, its row stays. All other columns pass
through unchanged, whatever their names, but for a column ``line_dedup``, which is replaced. Outer white space is spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.llm.common import store, unused

RATIO = 0.08
FLOOR = 2  # pages: a line of one page is no boilerplate


def _line_key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = FLOOR, by_text: bool = False) -> DataFrame:
    """Boilerplate lines of ``pages`` (host, text): host, lines (their keys, in order). ``by_text``: pages of a host with equal
    texts count as one, so that copies do not make each other's lines boilerplate; a line is then sent with a hash of its page."""
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _line_key))
    sent, rows = pages.select("host", F.explode(lines).alias("line")), pages.select("host")
    if by_text:
        page = F.xxhash64("text").alias("page")
        sent, rows = pages.select("host", F.explode(lines).alias("line"), page).distinct(), pages.select("host", page).distinct()
    seen = sent.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = rows.groupBy("host").agg(F.count("*").alias("total")).select(F.col("host").alias("h"), "total")
    over = seen.join(totals, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > ratio * F.col("total"))
    return over.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = FLOOR, host: str = "source", text: str = "text", by_text: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all columns stay, n_lines and n_dropped (in a struct
    ``line_dedup``) are added."""
    found = store(boilerplate(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), ratio, min_pages, by_text)).df
    here, there, own = unused(docs, "line_host"), unused(docs, "line_keys"), unused(docs, "line_kept")
    found = found.select(F.col("host").alias(here), F.col("lines").alias(there))
    joined = docs.join(found, F.col(host).eqNullSafe(F.col(here)), "left")
    bad = F.coalesce(there, F.array().cast(found.schema[there].dataType))
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(bad, _line_key(x)) | (F.trim(x) == ""))
    out = joined.withColumn(own, kept)
    count = lambda n: F.coalesce(n, F.lit(0)).cast("long")  # noqa: E731 - null for a null text
    counts = F.struct(count(F.size(lines)).alias("n_lines"), count(F.size(lines) - F.size(own)).alias("n_dropped"))
    none = F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    out = out.withColumn("line_dedup", F.when(F.col(text).isNull(), none).otherwise(counts))
    return out.withColumn(text, F.when(F.col(there).isNull(), F.col(text)).otherwise(F.array_join(own, "\n"))).drop(here, there, own)
