"""Incremental jobs, resolution and registered queries."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studylake.checks.fixtures import BASE
from studylake.operators import resolve as H
from studylake.operators import studies as E
from studylake.sources.sinks import append_new
from studylake.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_append_is_idempotent(spark, tmp_path):
    target = str(tmp_path / "extract")
    first = spark.createDataFrame([("a", 1), ("b", 2), ("", 9)], "alias string, v int")
    append_new(spark, first, target)
    append_new(spark, spark.createDataFrame([("a", 7), ("c", 3), ("c", 3)], "alias string, v int"), target)
    append_new(spark, first, target)
    rows = spark.read.parquet(target).select("alias", "v").collect()
    assert sorted(map(tuple, rows)) == [("a", 1), ("b", 2), ("c", 3)]


def test_pack_and_unpack_countries(spark):
    rows = [("s1", "Spain", "ES", None), ("s1", "France", "FR", "open"), ("s1", "France", "FR", "open"), ("s2", "Italy", None, "x")]
    df = spark.createDataFrame(rows, "alias string, country string, abbr string, status string")
    assert sorted(map(tuple, E.unpack_countries(E.pack_countries(df)).collect()), key=str) == sorted(rows, key=str)


def test_resolve_ignores_input_order(spark):
    rows = [(1, "f", 1, 2, "b", "x"), (1, "f", 1, 1, "", "x"), (1, "f", 0, 9, None, "o"), (1, "f", 1, 3, "c", "y"), (2, "f", 2, 1, "z", "w")]
    ddl = "doc_id int, field string, layer int, tier int, value string, source string"
    want = {(1, "b"), (2, "z")}
    for data in (rows, rows[::-1]):
        assert {(r.doc_id, r.value) for r in H.resolve(spark.createDataFrame(data, ddl)).collect()} == want


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([(f"k{i % 7}", i) for i in range(30)], "alias string, v int")
    df.repartition(5).write.parquet(src)
    for _ in range(2):
        rows = J.arriving(spark, src, df.schema, 1)
        J.stream_append_new(rows, out, state).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == 7 and E.new_rows(df, stored, "alias").count() == 0


def test_sessions_by_slices(spark, tmp_path):
    """Batch and stream against a plain loop, with events on the very edge of the gap, late files and one busy user."""
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng, rows = random.Random(5), []
    for user in range(6):
        at = 1_700_000_000
        for _ in range(400 if user == 0 else 30):
            at += rng.choice([1, 600, 21_599, 21_600, 21_601, 90_000])
            rows.append((user, at))
    rng.shuffle(rows)
    want = set()
    for user in range(6):
        run: list[int] = []
        for at in [*sorted(a for u, a in rows if u == user), 1 << 40]:
            if run and at - run[-1] >= 21_600:
                want.add((user, run[0], run[-1] + 21_600, len(run)))
                run = []
            run.append(at)
    events = spark.createDataFrame(rows, "user_id int, at bigint").select("user_id", F.timestamp_seconds("at").alias("ts"))
    plain = lambda df: {tuple(r) for r in df.select("user_id", F.unix_seconds("started"), F.unix_seconds("ended"), "events").collect()}
    assert plain(J.idle_sessions(events)) == want
    events.repartition(5).write.parquet(src)
    for _ in range(2):
        rows_in = J.arriving(spark, src, events.schema, 1)
        J.stream_sessions(rows_in, out, state).trigger(availableNow=True).start().awaitTermination()
    sessions = J.stored_sessions(spark, out)
    newest = max(a for _, a in rows)
    assert plain(sessions) == want and plain(sessions.where("open")) == {w for w in want if w[2] > newest}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["field", "status", "n"] and df.count() > 0


SAMPLE = ["a7_export_json", "b3_html_tables", "c5_extract_section", "c7_section_lines", "c14_parse_pipe_table", "d12_merge_continuations", "d26_consolidated_schedule", "e7_assemble_studies", "f12_country_check_row", "h17_validate_records", "i5_form_record", "i10_plan_column_inserts"]
ALL = [n for n in entry.queries() if n in entry.oracle_sql()]


def plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", ALL if os.environ.get("STUDYLAKE_ALL_CHECKS") else SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for b in BASE:
        con.sql(f"create view {b} as select * from '{SF}/{b}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    b = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b


def test_filters_and_columns_reach_the_scan(spark, tmp_path, capsys):
    from studylake.sources.readers import PAGE, read_pages, read_study_tables

    ddl = {
        "study": "alias string, phase_raw string, area string, pediatric_raw string, unused string",
        "study_country": "alias string, country string, abbr string, status string, unused string",
        "enrollment": "alias string, enrollment_type string, plan_kind string, total int, unused string",
        "milestone": "alias string, milestone_type string, milestone_date date, unused string",
    }
    for name, columns in ddl.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], PAGE).write.parquet(f"{tmp_path}/pages")
    tables = read_study_tables(spark, str(tmp_path))
    capsys.readouterr()
    tables["enrollment"].explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(plan_kind,Planned)" in plan and "IsNotNull(alias)" in plan and "unused" not in plan
    read_pages(spark, f"{tmp_path}/pages", [2, 5]).select("doc_id", "page").explain("formatted")
    plan = capsys.readouterr().out
    assert "In(page, [2,5])" in plan and "blocks" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_ordered_steps_do_not_shuffle_by_document_alone(spark, capsys):
    from studylake.operators.structure import pipe_rows

    lines = spark.createDataFrame([(1, i, "| a | b |") for i in range(20)], "doc_id bigint, line_no int, text string")
    capsys.readouterr()
    pipe_rows(lines).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "hashpartitioning(doc_id" in plan and "_block" in plan
