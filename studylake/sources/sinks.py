"""Sinks: append-only study table, exported tables, and per-document reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.operators.studies import new_rows
from studylake.sources.readers import existing_keys, stored_table


BUCKETS = 256
BUCKET = "key_bucket"


def key_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def append_new(
    spark: SparkSession,
    rows: DataFrame,
    path: str,
    key: str = "alias",
    run_date: Column | None = None,
    first_by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> None:
    """Appends rows with unseen keys, stamped with the run date. A second run adds nothing and
    stored rows are never rewritten. Non-blank keys only. Of several rows of one key the first by ``first_by``
    is kept (see :func:`new_rows`), so that a retry keeps the same.

    The table is its own key index: it is partitioned by a hash of the key, and a run reads the key
    column of only those partitions its keys fall into, at most ``buckets`` numbers on the driver. A
    table that was stored without partitions stays so, and its keys are read whole. ``buckets`` must stay the same for a table.
    """
    kind, table = rows.schema[key].dataType.simpleString(), stored_table(spark, path)
    usable = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    stamp = run_date if run_date is not None else F.current_date()
    if table is not None and BUCKET not in table.columns:
        new_rows(usable, existing_keys(spark, path, key, kind), key, first_by).withColumn("extracted_on", stamp).write.mode("append").parquet(path)
        return
    usable = usable.withColumn(BUCKET, key_bucket(F.col(key), buckets))
    touched = [r[0] for r in usable.select(BUCKET).distinct().collect()]
    stored = existing_keys(spark, path, key, kind, F.col(BUCKET).isin(touched))
    fresh = new_rows(usable, stored, key, first_by).withColumn("extracted_on", stamp)
    fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)


def escape_html(col: Column) -> Column:
    text = F.replace(F.coalesce(col, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_markdown(col: Column) -> Column:
    return F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def pack_content(contents: DataFrame, folder: str) -> None:
    """Writes ``(path, content)`` as container files, for corpora of very many small contents."""
    contents.select("path", "content").write.parquet(folder)


def export_rows(rows: DataFrame, fmt: str) -> DataFrame:
    """``(doc_id, table_no, line_no, part, text)``: each row of ``(…, is_header, cells)`` as one
    line of a Markdown or HTML table, or a JSON array. Lines are written as they are; only
    :func:`export_table` joins them."""
    cells, head = F.col("cells"), F.col("is_header")
    if fmt == "markdown":
        line = F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_markdown), " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.transform(cells, lambda c: F.lit("---")), " | "), F.lit(" |"))
        text = F.when(head, F.concat(line, rule)).otherwise(line)
    elif fmt == "html":
        wrap = lambda tag: F.concat(
            F.lit("<tr>"),
            F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag}>"))), ""),
            F.lit("</tr>"),
        )
        text = F.when(head, wrap("th")).otherwise(wrap("td"))
    else:
        text = F.to_json(cells)
    return rows.select("doc_id", "table_no", "line_no", "is_header", text.alias("text"))


def export_table(rows: DataFrame, fmt: str) -> DataFrame:
    """``(doc_id, table_no, content)``: one exported table per row, for a text sink."""
    lines = export_rows(rows, fmt)
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "is_header", "text")))
    body = F.transform(F.filter(F.col("_l"), lambda r: ~r["is_header"]), lambda r: r["text"])
    head = F.filter(F.col("_l"), lambda r: r["is_header"])[0]["text"]
    grouped = lines.groupBy("doc_id", "table_no").agg(ordered.alias("_l"))
    if fmt == "markdown":
        content = F.array_join(F.concat(F.array(head), body), "\n")
    elif fmt == "html":
        content = F.concat(
            F.lit("<table>\n<thead>"), head, F.lit("</thead>\n<tbody>\n"), F.array_join(body, "\n"), F.lit("\n</tbody>\n</table>")
        )
    else:
        content = F.concat(F.lit('{"columns":'), head, F.lit(',"rows":['), F.array_join(body, ","), F.lit("]}"))
    return grouped.select("doc_id", "table_no", content.alias("content"))


def report_lines(findings: DataFrame, width: int | None = None) -> DataFrame:
    """``(doc_id, ord, line)`` of the findings table of a report; on request values are cut to ``width`` characters."""
    cell = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("/"))
    value = cell("value") if width is None else F.substring(cell("value"), 1, width)
    line = F.concat(
        F.lit("| "), cell("field"), F.lit(" | "), value, F.lit(" | "), cell("source"),
        F.lit(" | "), F.col("status"), F.lit(" |"),
    )
    return findings.select("doc_id", "ord", line.alias("line"))


def write_report(findings: DataFrame, coverage: DataFrame, width: int | None = None) -> DataFrame:
    """``(doc_id, report)``: coverage line and findings table. The number of tracked fields per
    document is fixed by the catalog, so a report is small."""
    rows = report_lines(findings, width).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("_r"))
    head = F.format_string(
        "**Coverage:** %d filled · %d computed · %d need review (of %d tracked items)", "filled", "computed", "review", "total"
    )
    return rows.join(coverage, "doc_id").select(
        "doc_id",
        F.concat(
            head,
            F.lit("\n\n| Field | Value | Source | Status |\n|---|---|---|---|\n"),
            F.array_join(F.transform("_r", lambda r: r["line"]), "\n"),
        ).alias("report"),
    )
