"""Documents longer than any window an operator might look at, and nested schemas."""

import json

from pyspark.sql import functions as F

from studylake.functions.text import strip_json_suffix
from studylake.operators import countries, evidence, fields, resolve, schedule, structure


def lines_df(spark, lines):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, text string")


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def test_laboratory_range_has_no_length(spark):
    lines = ["Appendix 2 Clinical Laboratory Tests", *[f"Analyte {i}" for i in range(800)]]
    r = structure.detect_line_ranges(lines_df(spark, lines)).first()
    assert (r.lab_start, r.lab_end) == (0, 801)


def test_appendix_without_stop_is_whole(spark):
    text = "Appendix 2: Clinical Laboratory\n" + "\n".join(f"Analyte number {i}" for i in range(900))
    assert len(value(spark, text, structure.appendix_block)) == 901


def test_schedule_rows_far_below_their_visits(spark):
    filler = [f"Assay {i} of serum  X  " for i in range(40)]
    rows = schedule.parse_schedule_lines(lines_df(spark, ["Visit Number  1  2", *filler])).collect()
    assert len(rows) == 40 and all(r.visits == [1] for r in rows)


def test_dump_of_any_length_is_cut(spark):
    lines = [*["prose"] * 8, "{", '"pages": [', *["0,"] * 6000]
    assert strip_json_suffix(lines_df(spark, lines)).count() == 8


def test_tissue_section_is_whole(spark):
    text = "start tumor tissue " + "word " * 400 + "unstained slides " + "word " * 900 + "archival tissue end"
    windows = value(spark, text, lambda t: structure.keyword_windows(t, ["word"], 20))
    assert len(windows) > 3
    found = evidence.tissue_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert "archival tissue end" in found.section


def test_planned_number_late_in_the_text(spark):
    late = "filler text. " * 9000
    near = value(spark, "Approximately 240 participants will be enrolled", fields.enrollment_first)
    assert near is not None
    assert value(spark, late + "Approximately 240 participants will be enrolled", fields.enrollment_first) == near


def test_schema_leaves(spark):
    schema = {
        "required": ["a"],
        "properties": {
            "a": {"type": "object", "properties": {"b": {"properties": {"c": {}}, "type": "object", "required": ["c"]}}},
            "n": {"anyOf": [{"type": "null"}, {"type": "string", "enum": ["x", "y"]}]},
            "r": {"type": "object", "properties": {"rows": {"type": "array", "items": {"required": ["k"], "properties": {"k": {"type": "integer"}}}}}},
        },
    }
    data = [(1, json.dumps(schema)), (2, "{}"), (3, "no json"), (4, None)]
    rows = resolve.flatten_schemas(spark.createDataFrame(data, "schema_id int, json string")).collect()
    assert sorted((r.schema_id, r.section, r.field_name, r.type, r.required, r.nullable, r.enum, r.parent_path) for r in rows) == [
        (1, "a", "b.c", "string", True, False, None, "b"),
        (1, "n", "n", "string", False, True, ["x", "y"], ""),
        (1, "r", "rows[].k", "integer", True, False, None, "rows"),
    ]


def run_check(name, **tables):
    from types import SimpleNamespace

    from studylake.checks import load
    from studylake.checks.registry import REGISTRY

    load()
    return REGISTRY[name].run(SimpleNamespace(**tables)).collect()


def test_queries_find_their_sections_anywhere(spark):
    filler = ["plain words"] * 200
    design = lines_df(spark, [*filler, "39. Planned Enrollment", "Approximately 250 patients will be enrolled.", "45. Timeline", "FPV: 3-March-2026", "50. Other"])
    assert [r.planned for r in run_check("f24_enrollment_section", design_line=design)] == [250]
    bare = lines_df(spark, ["39. Planned Enrollment", "10000 patients are planned", "45. Timeline"])
    assert [r.planned for r in run_check("f24_enrollment_section", design_line=bare)] == [0]  # four digits at most, as its SQL reads them
    assert [(r.milestone, r.value) for r in run_check("f15_milestones_section", design_line=design)] == [("FPV", "3-March-2026")]
    rows = ["| Clinical Laboratory Tests | Comments |", "|---|---|", *[f"| Analyte {i} HIV | blinded |" for i in range(90)], "", "| Other | Comments |", "|---|---|", "| HIV | blinded |"]
    protocol = lines_df(spark, [*filler, *rows])
    assert sorted(r.line_no for r in run_check("f29_analytes_by_phrase", protocol_line=protocol)) == list(range(202, 292))
    assert run_check("f32_reflex_by_presence", protocol_line=protocol)
    panels = lines_df(spark, ["Appendix 2: Laboratory matters", "Lipids assayed by sponsor-designated laboratory", "Insulin"])
    assert [(r.name, r.tests) for r in run_check("d21_parse_panels", mapper_line=panels)] == [("Lipids", "Insulin")]


def test_blocks_end_at_headings_only(spark):
    filler = "plain words of the plan\n" * 300
    plan = "Based on XYZ countries in scope include\n" + filler + "- Japan at target 30%\n\n## 40. Other\nItaly\n"
    docs = spark.createDataFrame([(1, plan)], "doc_id int, text string")
    for found in (countries.country_mentions(docs), countries.country_section(docs)):
        assert [(r.name, r.pct) for r in found.collect()] == [("Japan", 0.3)]
    text = "Timeline\n" + filler + "FPV: 3-March-2026\n"
    assert value(spark, "fpv: unknown\n" + text, fields.milestones_text)["FPV"] == "3-March-2026"
    for phrase in ("Translations list: ", "Translate into "):
        assert value(spark, f"# 4. Before\nThai\n# 5. Texts\n{phrase}\n{filler}German\n# 6. After\nSpanish", fields.required_languages) == ["German"]


def test_evidence_is_not_clipped(spark):
    text = "before " * 60 + "biomarker assessments in tumor samples" + " after" * 100
    row = evidence.evidence_catalog(spark.createDataFrame([(1, text)], "doc_id int, section string")).where(F.col("label") == evidence.PRESENT).first()
    assert len(row.evidence) > 700 and not row.evidence.endswith("...")


def test_keyword_windows_are_all_given(spark):
    text = "".join(f"number {i} of the words and so on. " * 3 for i in range(60))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert len(run_check("g1_keyword_windows", documents=docs)) > 100
