"""Append-only table: keys, duplicates, and errors that must not look like a missing table."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from studylake.sources.readers import existing_keys, read_content
from studylake.sources.sinks import BUCKET, append_new, key_bucket, pack_content


def test_append_keeps_largest_and_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "studies")
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("", 9), (None, 9)], "alias string, size int")
    for _ in range(2):
        append_new(spark, rows, path, run_date=F.lit("2020-01-01"))
    assert sorted((r.alias, r.size) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_missing_key_column_is_an_error(spark, tmp_path):
    path = str(tmp_path / "other")
    spark.range(1).write.parquet(path)
    with pytest.raises(AnalysisException):
        append_new(spark, spark.createDataFrame([("a",)], "alias string"), path)


def test_append_keeps_the_first_by_an_order(spark, tmp_path):
    path = str(tmp_path / "ordered")
    rows = spark.createDataFrame([("a", 5, "late"), ("a", 2, "early"), ("a", 2, "easier"), ("b", 9, "only")], "alias string, at int, what string")
    for _ in range(2):
        append_new(spark, rows, path, first_by=["at"])
    append_new(spark, spark.createDataFrame([("a", 0, "later run")], rows.schema), path, first_by=["at"])
    assert sorted((r.alias, r.what) for r in spark.read.parquet(path).collect()) == [("a", "early"), ("b", "only")]


def test_append_reads_only_the_buckets_of_its_keys(spark, tmp_path, capsys):
    """A small batch against a large table: the stored keys it reads lie in the partitions of its own keys."""
    path = str(tmp_path / "large")
    append_new(spark, spark.range(3000).select(F.concat(F.lit("k"), "id").alias("alias"), "id"), path, buckets=64)
    batch = spark.createDataFrame([("k7", 0), ("new", 1)], "alias string, id bigint")
    numbers = [r[0] for r in batch.select(key_bucket(F.col("alias"), 64)).distinct().collect()]
    stored = existing_keys(spark, path, "alias", within=F.col(BUCKET).isin(numbers))
    capsys.readouterr()
    stored.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [" in plan and f"{BUCKET}#" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert 0 < stored.count() < 300
    append_new(spark, batch, path, buckets=64)
    table = spark.read.parquet(path)
    assert table.count() == 3001 and table.where("alias = 'k7'").collect()[0]["id"] == 7


def test_append_to_a_table_without_buckets(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([("a", 1)], "alias string, v int").write.parquet(path)
    append_new(spark, spark.createDataFrame([("a", 2), ("b", 3)], "alias string, v int"), path)
    assert sorted((r.alias, r.v) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_contents_are_packed_into_few_files(spark, tmp_path):
    texts = {f"doc_id={i}.md": "line one\r\nline two\n" * (i % 3) for i in range(200)}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string").coalesce(2)
    pack_content(rows, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) <= 2
    assert {r.path: r.content for r in read_content(spark, str(tmp_path / "packed"), packed=True).collect()} == texts
    (tmp_path / "one.md").write_text("a\nb\n")
    assert [(r.format, r.content) for r in read_content(spark, str(tmp_path / "one.md")).collect()] == [("markdown", "a\nb\n")]
