"""Design documents as one record per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.fixed import AREA_KEYWORDS
from studylake.functions.stage import stage
from studylake.operators.countries import country_section, exact_hits
from studylake.operators.fields import (
    area_in_design,
    design_flags,
    enrollment_section,
    first_number,
    milestones_qa,
    milestones_section,
    min_age,
)
from studylake.operators.structure import parse_sections, question_rows

def _first(value: str) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), F.col("line_no")))


def _last(value: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_no")))


def qa_fields(rows: DataFrame) -> DataFrame:
    """Fields of question tables, one row per document: enrollment and rates, milestones,
    countries, flags, phase and area, each from the rows of its sub-section.

    A value is read once, and only from rows that are asked for it; the choice among rows compares line numbers."""
    section = F.lower(F.trim("sub_section"))
    words = F.when(section.isin("title", "overview"), F.lower(F.concat_ws(" ", "detail", "element")))
    asked = rows.select("doc_id", "line_no", "detail", section.alias("section"), F.lower("detail").alias("low"), F.lower("element").alias("element"), words.alias("words"))
    section, detail, low, element = (F.col(c) for c in ("section", "detail", "low", "element"))
    stats = section.isin("stats", "objectives / stats")
    design = section.isin("design", "design / ct material")
    planned = F.coalesce(first_number(detail, [r"N\s*=\s*(\d+)"]), first_number(detail, [r"(?i)(?:Approximately|About|Total of)\s+(\d+)"]))
    drop = first_number(detail, [r"(?i)discontinuation\s+rate\s+(?:of\s+)?(?:approximately\s+)?(\d+)\s*%"]) / F.lit(100)
    fail = first_number(detail, [r"(?i)screen\s*fail(?:ure)?\s*(?:rate)?\s*[:=]?\s*(\d+)\s*%"]) / F.lit(100)
    immuno = F.when(low.startswith("yes") | low.contains("will be collected"), True).when(low.startswith("no"), False)
    genetic = F.when(low.startswith("yes") | low.contains("collect"), True).when(low.startswith("no") | low.startswith("n/a"), False)
    by_word = F.when(low.rlike("n/a|only participants over 18|adults only"), False).when(low.rlike("yes|adolescent|pediatric"), True)
    place = F.when(section == "peds", 0).when(section == "population", 1).when(section == "inclusion", 2).when(section == "eligibility", 3)
    phase = r"(?i)Phase\s+(\d+[a-z]?)"
    dates = F.array_join(F.transform(F.map_entries(milestones_qa(detail)), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    values = {
        "planned": F.when(stats, planned),
        "fail": F.when(stats, fail),
        "drop": F.when(stats, drop),
        "milestones": F.when(section == "timeline", dates),
        "immuno": F.when(design & element.contains("immunogenicity"), immuno),
        "genetic": F.when(design & element.rlike("genetics|pgx"), genetic),
        "place": place,
        "age": F.when(place.isNotNull(), min_age(detail)),
        "by_word": F.when(section == "peds", by_word),
        "phase": F.when((section == "title") & element.contains("phase") & detail.rlike(phase), F.regexp_extract(detail, phase, 1)),
        "keyword": F.when(F.col("words").isNotNull(), F.coalesce(*[F.when(F.col("words").contains(w), i) for i, (w, _) in enumerate(AREA_KEYWORDS)])),
        "checked": F.when(section == "country check", exact_hits(detail)),
        "named": F.when((section == "overview") & element.rlike("regulatory|country"), exact_hits(detail)),
    }
    # each row's values are put together before they are compared: nothing below reads a text again
    read = asked.select("doc_id", "line_no", "section", *[v.alias(c) for c, v in values.items()]).withColumn("named", F.when(F.size("named") > 0, F.col("named")))
    none = F.array().cast("array<string>")
    return read.groupBy("doc_id").agg(
        _first("planned").alias("planned"),
        F.coalesce(_last("fail"), F.lit(0.30)).alias("screen_fail_rate"),
        F.coalesce(_last("drop"), F.lit(0.10)).alias("early_discontinuation_rate"),
        F.min_by("milestones", F.when(F.col("section") == "timeline", F.col("line_no"))).alias("milestones"),
        _last("immuno").alias("immunogenicity_needed"),
        _last("genetic").alias("genetics_collected"),
        F.coalesce(F.min_by("age", F.when(F.col("age").isNotNull(), F.struct("place", "line_no"))) < 18, _last("by_word")).alias("includes_pediatric"),
        _last("phase").alias("phase"),
        # The first keyword in dictionary order over all title and overview rows.
        F.get(F.array(*[F.lit(area) for _, area in AREA_KEYWORDS]), F.min("keyword")).alias("area"),
        F.array_join(F.array_sort(F.coalesce(F.nullif(_last("checked"), none), _last("named"), none)), "; ").alias("countries"),
    )


def qa_countries(rows: DataFrame) -> DataFrame:
    """``(doc_id, key, pct, consideration)`` of the check row of question tables: the first share
    after the name within its sentence, and a word of doubt close to it."""
    from studylake.functions.fixed import ALIASES

    checks = rows.where(F.lower(F.trim("sub_section")) == "country check")
    entries = []
    for key, names in ALIASES.items():
        for i, n in enumerate(names):
            quoted = rf"\Q{n}\E"
            near = F.lower(F.regexp_extract(F.col("detail"), rf"(?is)(.{{0,20}}{quoted}.{{0,50}})", 1))
            entries.append(
                F.when(
                    F.col("detail").rlike(rf"\b{quoted}\b"),
                    F.struct(
                        F.lit(key).alias("key"),
                        F.lit(i).alias("spelling"),
                        (first_number(F.col("detail"), [rf"{quoted}[^.]*?(\d+)\s*%"]) / F.lit(100)).alias("pct"),
                        near.rlike("consideration|low probability").alias("consideration"),
                    ),
                )
            )
    found = checks.select("doc_id", F.inline(F.array_compact(F.array(*entries))))
    return found.groupBy("doc_id", "key").agg(F.min_by(F.struct("pct", "consideration"), "spelling").alias("c")).select("doc_id", "key", "c.*")


def _pick(sections: DataFrame, number: str, title: str) -> DataFrame:
    """The section with the number, else the first whose title has the word."""
    hit = (F.col("number") == number) | F.lower("title").contains(title)
    rank = F.struct((F.col("number") != number).cast("int"), F.col("start_line"))
    return sections.where(hit).groupBy("doc_id").agg(F.min_by("text", rank).alias("text"))


def design_record(lines: DataFrame) -> DataFrame:
    """One row per document: from its numbered sections, or from its question table where it has
    no sections. Every part is one row per document before it is joined."""
    sections = stage(parse_sections(lines))
    docs = sections.select("doc_id").distinct()
    top = sections.where("level = 1")
    dates = _pick(sections, "45", "timeline").select("doc_id", milestones_section(F.col("text")).alias("milestones"))
    planned = enrollment_section(F.col("text"))
    direct = _pick(sections, "39", "enrollment").select("doc_id", planned.alias("direct"))
    scanned = (
        top.select("doc_id", "start_line", planned.alias("e"))
        .where("e.planned > 0")
        .groupBy("doc_id")
        .agg(F.min_by("e", "start_line").alias("scanned"))
    )
    countries = country_section(_pick(sections, "38", "country")).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("consideration", "name", "abbreviation", "pct", "sites"))).alias("countries")
    )
    area = (
        lines.where(F.col("text").rlike(r"(?i)Therapeutic\s+Area|TA:"))
        .select("doc_id", "line_no", area_in_design(F.col("text")).alias("area"))
        .where("area is not null")
        .groupBy("doc_id")
        .agg(F.min_by("area", "line_no").alias("area"))
    )
    by_section = docs
    for part in (dates, direct, scanned, countries, design_flags(top), area):
        by_section = by_section.join(part, "doc_id", "left")
    enrolled = F.coalesce("direct", "scanned")
    by_section = by_section.select(
        "doc_id",
        enrolled["planned"].alias("planned"),
        F.coalesce(enrolled["screen_fail_rate"], F.lit(0.30)).alias("screen_fail_rate"),
        F.coalesce(enrolled["early_discontinuation_rate"], F.lit(0.10)).alias("early_discontinuation_rate"),
        F.array_join(F.transform(F.array_sort(F.map_entries("milestones")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ").alias("milestones"),
        "immunogenicity_needed",
        "genetics_collected",
        "includes_pediatric",
        F.lit(None).cast("string").alias("phase"),
        "area",
        F.array_join(F.transform("countries", lambda c: c["name"]), "; ").alias("countries"),
    )
    other = lines.join(docs, "doc_id", "left_anti")
    return by_section.unionByName(qa_fields(question_rows(other)))
