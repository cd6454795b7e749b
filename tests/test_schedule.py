"""Schedule parsing on hand-written documents."""

from pyspark.sql import functions as F

from studylake.operators import schedule as D

# Documents, and the rows (visits, label, marks, comment) a reader finds in them.
DOCUMENTS = {
    "a divider takes in the title below it": (
        ["| Visit | 1 | 2 |", "| LABORATORY TESTS | | |", "| PART B | | |", "| Visit | 3 | 4 |", "| Glucose in fasting plasma | X | |"],
        [(("3", "4"), "Glucose in fasting plasma", ("X", ""), "")],
    ),
    "a title names the visits below it, cells beyond them are comments": (
        ["| Part B | | |", "| Visit | 15 | 22 |", "| Clinical chemistry of the serum | X | | late | again |"],
        [(("Part B: 15", "Part B: 22"), "Clinical chemistry of the serum", ("X", ""), "late again")],
    ),
    "a label goes on in the next row": (
        ["| Study day | -2 | 1 |", "|---|---|---|", "| Hematology panel with differential | X | |", "| and smear | | |"],
        [(("-2", "1"), "Hematology panel with differential and smear", ("X", ""), "")],
    ),
    "visits in two rows": (
        ["| | | -35 to |", "| Study day | -2 | 1 |", "| Iron in plasma of participants | | X |"],
        [(("-2", "-35 to 1"), "Iron in plasma of participants", ("", "X"), "")],
    ),
    "equal headers share a table": (
        ["| Visit | 1 | 2 |", "| Zinc in serum, long name | X | |", "| Visit | 1 | 2 |", "| Iron in plasma of participants | | X |"],
        [(("1", "2"), "Zinc in serum, long name", ("X", ""), ""), (("1", "2"), "Iron in plasma of participants", ("", "X"), "")],
    ),
    "rows that stand three times are page furniture": (
        ["| Visit | 1 | 2 |", *["| note block row | Q | |"] * 3, "| Zinc in serum, long name | X | |"],
        [(("1", "2"), "Zinc in serum, long name", ("X", ""), "")],
    ),
    "no header": (["| no header here | X |", "text between"], []),
}
DIVIDED = [
    "| Study day | -2 | 1 | 8 |", "| Clinical chemistry of the serum | | X | |", "| Randomization and | | | |", "| dosing-related | | | |",
    "| activities | | | |", "| Zinc in serum, long name | X | X | X |",
]


def lines_df(spark, documents):
    data = [(d, i, t) for d, ts in documents.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(data, "doc_id string, line_no int, text string")


def test_rows_of_documents(spark):
    rows = D.schedule_rows(lines_df(spark, {d: lines for d, (lines, _) in DOCUMENTS.items()}))
    got = {}
    for r in rows.orderBy("doc_id", "table_ord", "row_ord").collect():
        got.setdefault(r.doc_id, []).append((tuple(r.visits), r.label, tuple(r.marks), r.comment))
    for doc, (_, expected) in DOCUMENTS.items():
        assert got.get(doc, []) == expected, doc


def test_divider_wraps_over_rows(spark):
    rows = D.drop_dividers(D.with_headers(D.matrix_rows(lines_df(spark, {"a": DIVIDED}))))
    assert {r.line_no for r in rows.where("divider").collect()} == {2, 3, 4}


def test_pivot_round_trip(spark):
    marks = spark.createDataFrame([(1, "a", "V1", "X"), (1, "a", "V2", "Y"), (1, "b", "V2", "X"), (2, "a", "V1", "X")], "doc_id int, label string, visit string, mark string")
    back = D.unpivot_matrix(D.pivot_matrix(marks, ["V1", "V2"]), ["V1", "V2"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, marks.collect()))


def test_visit_headers(spark):
    cases = {"": True, "Comments": False, "Visit 3 Hour 2": True, "Day 1-3": True, "RT": False, "12 hr": True, "A rather long header": False, "V1a": True}
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = {r.h: r.v for r in df.select("h", D.is_visit_column(F.col("h")).alias("v")).collect()}
    assert got == cases


def test_row_filters(spark):
    df = spark.createDataFrame([("Vital signs",), ("Follow-up blood sample",), ("Prolactin",), ("ECG",), ("Serum pregnancy test diary",)], "l string")
    got = {r.l: (r.n, r.d) for r in df.select("l", D.is_non_lab(F.col("l")).alias("n"), D.is_dropped_row(F.col("l")).alias("d")).collect()}
    assert got == {
        "Vital signs": (True, True), "Follow-up blood sample": (False, False), "Prolactin": (False, False), "ECG": (True, True),
        "Serum pregnancy test diary": (False, False),
    }


def test_short_and_long_documents_alike(spark):
    """The same documents far down a long one give the same rows."""
    lines = lines_df(spark, {d: lines for d, (lines, _) in DOCUMENTS.items()})
    far = lines.select("doc_id", (F.col("line_no") + 4094).alias("line_no"), "text")
    read = lambda part, by: sorted((r.doc_id, r.table_ord - by, r.row_ord - by, r.label, *r.visits, *r.marks) for r in D.schedule_rows(part).collect())
    assert read(lines, 0) == read(far, 4094)
    named = lambda part, by: sorted((r.doc_id, r.line_no - by, r.divider, *(r.header.visits if r.header else [])) for r in D.named_rows(D.matrix_rows(part)).collect())
    assert named(lines, 0) == named(far, 4094)


def test_rows_are_split_once(spark):
    """A filter on what is read out of a row does not read it again."""
    lines = lines_df(spark, {d: lines for d, (lines, _) in DOCUMENTS.items()})
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(D.matrix_rows(lines).where("kind <> 'separator'").select("doc_id", "cells")).count("split(") == 1
    assert D.drop_repeated(D.matrix_rows(lines))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
