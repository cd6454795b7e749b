"""Schedule steps read their lines once; cells, dividers and tables stay the same."""

from __future__ import annotations

from random import Random

from pyspark.sql import functions as F

from studylake.functions.sequence import by_length
from studylake.operators import schedule as D
from studylake.operators.structure import lines_in_ranges, split_row


def lines_of(spark, texts):
    return spark.createDataFrame([(d, i, t) for d, own in texts.items() for i, t in enumerate(own)], "doc_id bigint, line_no int, text string")


MATRIX = ["| Arm A | | |", "| Study day | 1 | 8 |", "|---|---|---|", "| Vital signs and | | |", "| other assessments | | |", "| Weight | X | |", "| and height | | | note |", "| Study day | 1 | 8 |"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_schedule_rows_read_lines_once(spark):
    lines = lines_of(spark, {1: MATRIX, 2: MATRIX[1:]})
    text = plan(D.schedule_rows(lines))
    assert text.count("split(") == 1 and "Join" not in text
    assert {(r.doc_id, r.table_ord, r.row_ord, r.label, r.comment) for r in D.schedule_rows(lines).collect()} == {
        (1, 1, 5, "Weight and height", "note"), (2, 0, 4, "Weight and height", "note")
    }


def test_groups_are_named_in_one_pass(spark):
    rows = D.named_rows(D.matrix_rows(lines_of(spark, {1: MATRIX})))
    heads = rows.where("is_header").select("doc_id", "line_no", "header.visits")
    text = plan(heads)
    assert text.count("split(") == 1 and "Join" not in text
    assert {(r.line_no, *r.visits) for r in heads.collect()} == {(1, "Arm A: 1", "Arm A: 8"), (7, "Arm A: 1", "Arm A: 8")}


def test_cells_are_those_of_plain_splitting(spark):
    random = Random(3)
    texts = ["".join(random.choice(["|", "|", " ", "  ", "\t", "a", "b c", "\n"]) for _ in range(random.randrange(0, 12))) for _ in range(800)] + ["", "|", "||", "| |", " | a |", "a |  "]

    def plainly(t):
        cells = [c.strip(" \t\n\r\f\v") for c in t.split("|")]
        head = int(cells[0] == "")
        return cells[head : len(cells) - int(len(cells) > head and cells[-1] == "")]

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_row(F.col("t")).alias("c")).collect()
    assert all(r.c == plainly(r.t) for r in got)


def test_automaton_of_short_documents_equals_a_loop(spark):
    random = Random(5)
    docs = {d: [random.choice("rrc012345674567c") for _ in range(random.randrange(1, 40))] for d in range(60)}
    rows = spark.createDataFrame([(d, 3 * i + 1, c) for d, own in docs.items() for i, c in enumerate(own)], "doc_id int, line_no int, c string")
    taken = lambda c: F.when(c < "4", c.cast("int")).otherwise(c.cast("int") - 4)
    step = lambda s, c: F.when(c == "r", 0).when((s > 0) & (c >= "4"), s - 1).when(c == "c", 0).otherwise(taken(c))
    flag = lambda s, c: ((s > 0) & (c >= "4") & (c != "r")) | ((c != "c") & (c != "r"))
    want = set()
    for d, own in docs.items():
        left = 0
        for i, c in enumerate(own):
            goes_on = c in "c4567"
            if (left > 0 and goes_on) or c not in "cr":
                want.add((d, 3 * i + 1))
            left = 0 if c == "r" else left - 1 if left > 0 and goes_on else 0 if c == "c" else int(c) % 4
    for block in (4096, 9):  # one block, several
        out = by_length(rows, ["doc_id"], "line_no", lambda part, s: s.automaton(part, F.col("c"), 4, step, flag, "hit", "r"), block)
        assert {(r.doc_id, r.line_no) for r in out.where("hit").collect()} == want
        assert out.count() == rows.count()


MAPPER = [
    "Laboratory tests and sample collections", "Visit Number  1  2  3", "Hematology  X    X", "Zinc  X  -", "PK samples  X  X", "Lipids  X", "Appendix 2: Laboratory matters",
    "Hematology: assayed by sponsor-designated laboratory", "Hemoglobin", "Clinical notes", "Appendix 3: Other matters", "Zirconium",
]


def test_schedule_parts_read_short_documents_in_one_pass(spark):
    texts = {1: MAPPER, 2: MAPPER[1:], 3: MAPPER[:7], 4: MAPPER[6:], 5: MAPPER[:3] + MAPPER[5:], 6: ["", "CLINICAL LABORATORY TESTS", "Zinc"], 7: MAPPER[:1] + MAPPER}
    short = lines_of(spark, texts)
    ranged = lines_in_ranges(short)
    assert "Join" not in plan(ranged) and "Join" not in plan(D.parse_schedule_lines(short))
    long = short.withColumn("line_no", F.col("line_no") + 5000)
    of = lambda df, by: sorted((r.doc_id, r.line_no - by, r.part, r.text) for r in df.collect())
    assert of(ranged, 0) == of(lines_in_ranges(long), 5000)
    assert {(d, n) for d, n, part, _ in of(ranged, 0) if part == "schedule" and d < 4} == {(d, n) for d in (1, 3) for n in range(4)}
    assert {n for d, n, part, _ in of(ranged, 0) if (d, part) == (1, "lab")} == {6, 7, 8, 9}
    tests = lambda df, by: sorted((r.doc_id, r.name, r.line_no - by, r.is_panel, tuple(r.visits)) for r in D.schedule_parts(df)[0].collect())
    assert tests(short, 0) == tests(long, 5000)
    assert tests(short, 0)[:2] == [(1, "Hematology", 2, True, (1, 2)), (1, "Zinc", 3, False, (1,))]
