"""Values are read once and only where they are asked for: seen in the optimized plans, since results do not show it."""

from pyspark.sql import functions as F

from studylake.operators import fields as R
from studylake.operators import structure as S
from studylake.plans.design import qa_fields


def plan(df):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_a_milestone_is_matched_once(spark):
    texts = spark.createDataFrame([(1, "Protocol Approval: 3-Jan-2026.\nFPV: TBD\nLPV:\n")], "doc_id long, text string").repartition(1)
    df = texts.select("doc_id", F.explode(R.milestones_section(F.col("text"))))
    assert plan(df).count(r"\QProtocol Approval\E") == 1
    assert [tuple(r) for r in df.collect()] == [(1, "Protocol Approval", "3-Jan-2026")]


def test_a_section_line_carries_its_heading_once(spark):
    lines = spark.createDataFrame([(1, 0, "| 45. Timeline | FPV: May |"), (1, 1, "LPV: | June"), (1, 2, "46. Next")], "doc_id long, line_no int, text string").repartition(1)
    df = S.parse_sections(lines)
    assert " AS _h#" not in plan(df)
    assert [(r.number, r.title, r.text) for r in df.sort("start_line").collect()] == [("45", "Timeline", "FPV: May\nLPV: | June"), ("46", "Next", "")]


def test_rows_are_split_after_their_header_is_asked_for(spark):
    rows = ["| Lab | Note |", "|---|---|", "| a | b | c |", "| \t| |", "|", "| d", "text", "| Other |", "| e |"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc_id long, line_no int, text string").repartition(1)
    df = S.pipe_rows(lines).where(~F.col("is_header") & (F.col("header")[0] == "Lab"))
    assert " AS _c#" not in plan(df)
    assert [(r.line_no, r.cells) for r in df.sort("line_no").collect()] == [(2, ["a", "b"]), (5, ["d", ""])]


def test_answers_are_read_from_their_own_rows_only(spark):
    rows = [(1, 1, "Country Check", "x", "Japan and Spain"), (1, 2, "Overview", "Regulatory scope", "France; lupus"), (1, 3, "Stats", "x", "N=40 and screen fail rate: 7%"), (1, 4, "Peds", "x", "aged 12 to 17 years"), (2, 1, "Overview", "country", "Brazil"), (2, 2, "Stats", "x", None)]
    df = qa_fields(spark.createDataFrame(rows, "doc_id long, line_no int, sub_section string, element string, detail string").repartition(1))
    assert plan(df).count("regexp_extract_all") == 2
    found = {r.doc_id: r for r in df.collect()}
    assert (found[1].planned, found[1].screen_fail_rate, found[1].includes_pediatric, found[1].countries) == (40, 0.07, True, "Japan; Spain")
    assert (found[2].planned, found[2].screen_fail_rate, found[2].includes_pediatric, found[2].area, found[2].countries) == (None, 0.3, None, None, "Brazil")
