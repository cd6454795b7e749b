"""From documents to findings: the whole run on a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.functions import dates as DT
from studylake.functions.stage import stage
from studylake.functions.text import normalize_content, repaired, strip_json_suffix
from studylake.operators import countries as C
from studylake.operators import fields as R
from studylake.operators import resolve as H
from studylake.operators import schedule as D
from studylake.operators import structure as S

# Column -> field name and source of each tracked field.
TRACKED = {
    "alias": ("Protocol alias", "protocol"),
    "title": ("Protocol title", "protocol"),
    "compound": ("Compound", "protocol"),
    "phase": ("Phase", "protocol"),
    "area": ("Therapeutic Area", "protocol"),
    "indication": ("Indication", "protocol"),
    "immuno": ("Immunogenicity testing needed", "protocol"),
    "genetics": ("Genetics/PGx sample collected", "protocol"),
    "enrolled": ("Patients enrolled (randomized)", "protocol"),
    "screened": ("Patients screened", "computed (screen-fail rate)"),
    "min_age": ("Minimum age", "protocol"),
    "pediatric": ("Pediatric population?", "protocol inclusion criteria"),
    "oncology": ("Oncology study?", "protocol"),
    "inhibitor": ("Is this an Immuno Oncology protocol?", "protocol"),
    "us_oncology": ("US Oncology involved", "computed (oncology, countries)"),
    "blood_volume": ("Blood Volume per Visit Summary required", "computed (pediatric or China)"),
    "countries": ("Countries in scope", "design"),
    "allocation": ("Country Allocation table", "computed (design)"),
    "initial_country": ("Country where initial FPV planned", "design"),
    "languages": ("Translations", "computed (countries -> native language)"),
    "milestones": ("Trial Milestones", "design"),
    "duration": ("Protocol duration (FPV-DBL)", "computed (FPV to LPV + 1 month)"),
    "siv": ("Initial SIV date", "computed (FPV - 14 days)"),
    "training": ("Date training slides required", "computed (FPV - 3 weeks)"),
    "training_type": ("Type of training support required", "fixed default"),
    "visits": ("Total number of visits (Schedule of Activities)", "computed (schedule)"),
    "procedures": ("Schedule of Activities matrix", "protocol (pipe table)"),
    "analytes": ("Analytes", "protocol (pipe table)"),
    "not_reported": ("Analytes not reported to sites", "protocol"),
    "rule_visits": ("Hypersensitivity + Hepatic # patient visits", "computed (enrolled x visits)"),
}
TRAINING_TYPE = "Training slides only"


def text_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Scalar facts of whole texts, repaired first; row-local."""
    t = F.col(text)
    return repaired(docs, text).select(
        "doc_id",
        R.protocol_number(t).alias("alias"),
        R.title(t).alias("title"),
        R.compound(t).alias("compound"),
        R.phase(t).alias("phase"),
        F.coalesce(R.area_by_label(t), R.area_by_keyword(t)).alias("area"),
        R.indication(t).alias("indication"),
        R.immunogenicity(t).alias("immuno"),
        R.genetics(t).alias("genetics"),
        R.enrollment_first(t).alias("enrolled"),
        R.screen_fail_rate_strict(t).alias("rate"),
        R.min_age(t).alias("min_age"),
        R.is_oncology(t).alias("is_oncology"),
        F.when(R.has_checkpoint_inhibitor(t), "Yes").otherwise("No").alias("inhibitor"),
        F.nullif(F.array_join(R.not_reported_groups(t, F.lit(None).cast("string"), R.immunogenicity(t)), ", "), F.lit("")).alias("not_reported"),
    )


def with_overrides(facts: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """Facts with the non-blank values of ``(doc_id, field, value)`` in place of extracted ones, before anything is derived
    from them. A document has at most as many overrides as there are fields."""
    if overrides is None:
        return facts
    given = overrides.where(F.trim("value") != "").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_o"))
    names = {c: TRACKED[c][0] for c in facts.columns if c in TRACKED}
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    value = lambda c: F.coalesce(F.try_element_at("_o", F.lit(names[c])).try_cast(kinds[c]), F.col(c)).alias(c)
    return facts.join(given, "doc_id", "left").select(*[value(c) if c in names else c for c in facts.columns])


def country_facts(mentions: DataFrame) -> DataFrame:
    """``(doc_id, countries, allocation, languages)`` as written in a report; a document names few countries."""
    names = lambda maybe: F.array_join(F.sort_array(F.collect_set(F.when(F.col("consideration") == maybe, F.col("name")))), ", ")
    listed = mentions.groupBy("doc_id").agg(
        names(False).alias("_in"), names(True).alias("_maybe"), F.count("*").alias("_n"), F.count_if("consideration").alias("_m")
    )
    label = F.concat("_in", F.when(F.col("_maybe") != "", F.concat(F.lit(" [consideration: "), "_maybe", F.lit("]"))).otherwise(""))
    split = F.format_string("%d countries (%d in scope, %d consideration)", F.col("_n"), F.col("_n") - F.col("_m"), F.col("_m"))
    spoken = C.translation_languages(mentions).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("language")), ", ").alias("languages"))
    return listed.select("doc_id", F.trim(label).alias("countries"), split.alias("allocation")).join(spoken, "doc_id", "left")


def timeline_facts(timeline: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, milestones, duration, siv, training)``: dates as written, and those that follow from the first and last visit."""
    read = repaired(timeline, text).select("doc_id", R.milestones_text(F.col(text)).alias("_m"))
    found = read.select("doc_id", F.explode(F.array("_m")).alias("_m"))  # a border: milestones are found once
    day = lambda k: DT.parse_date_any(F.try_element_at("_m", F.lit(k)))
    days = found.select("doc_id", "_m", F.struct(day("FPV").alias("first"), day("LPV").alias("last")).alias("_d"))
    dated = days.select("doc_id", "_m", F.explode(F.array("_d")).alias("_d")).select("doc_id", "_m", F.col("_d.first").alias("_first"), F.col("_d.last").alias("_last"))
    return dated.select(
        "doc_id",
        F.array_join(F.transform(F.map_entries("_m"), lambda e: F.concat_ws(": ", e["key"], e["value"])), ", ").alias("milestones"),
        F.concat(DT.months_calendar(F.col("_first"), F.col("_last")), F.lit(" months")).alias("duration"),
        DT.long_date(F.date_sub("_first", 14)).alias("siv"),
        DT.long_date(F.date_sub("_first", 21)).alias("training"),
    )


def table_facts(lines: DataFrame) -> DataFrame:
    """``(doc_id, visits, procedures, analytes)`` of the best schedule and the best analyte table
    of each document."""
    rows = stage(S.pipe_rows(lines))
    soa = rows.join(S.best_table(rows, "soa"), ["doc_id", "table_no"])
    lab = rows.join(S.best_table(rows, "lab"), ["doc_id", "table_no"])
    label = F.col("cells")[0]
    heads = F.size(F.filter("cells", lambda c, i: (i > 0) & D.is_visit_column(c)))
    schedule = soa.groupBy("doc_id").agg(
        F.max(F.when(F.col("is_header"), heads)).alias("visits"),
        F.count_if(~F.col("is_header") & ~D.is_non_lab(label)).alias("procedures"),
    )
    analytes = lab.groupBy("doc_id").agg(F.count_if(~F.col("is_header") & (label != "")).alias("analytes"))
    return schedule.join(analytes, "doc_id", "full_outer")


def document_findings(
    docs: DataFrame, lines: DataFrame, design: DataFrame | None = None, timeline: DataFrame | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """Tracked findings of every document from its text and its lines; countries from its ``design`` text and
    milestones from its ``timeline``, by default from its own text. A page dump behind the lines is cut off, and every text is repaired before
    it is read. ``docs`` may name a ``format`` of the text (Markdown, HTML, JSON); then it is turned into plain text first."""
    if "format" in docs.columns:
        docs = stage(normalize_content(docs, "format", "text"))
    # Reading texts costs far more than moving them: they are dealt out first, however few files they lie in, and to a fixed
    # number of tasks, since by their size alone they would be put together into few.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.repartition(tasks, "doc_id")
    design = docs if design is None else design.repartition(tasks, "doc_id")
    timeline = design if timeline is None else timeline.repartition(tasks, "doc_id")
    facts = stage(with_overrides(text_facts(docs), overrides))
    mentions = stage(C.country_mentions(repaired(design)))
    unset = {"is_pediatric": F.lit(None).cast("boolean"), "pediatric_override": F.lit(None).cast("string"), "oncology_override": F.lit(None).cast("string")}
    flags = H.derived_flags(facts.withColumns(unset).select("doc_id", "min_age", "is_oncology", *unset), mentions)
    first = repaired(design).select("doc_id", C.initial_country(F.col("text")).alias("initial_country"))
    joined = facts
    for more in (table_facts(strip_json_suffix(lines)), flags, country_facts(mentions), first, timeline_facts(timeline)):
        joined = joined.join(more, "doc_id", "left")
    derived = {
        "screened": H.screened_count(F.col("enrolled"), F.coalesce("rate", F.lit(0.30))),
        "rule_visits": H.rule_visits(F.col("enrolled"), F.col("visits")),
        "training_type": F.lit(TRAINING_TYPE),
    }
    return H.to_findings(joined.withColumns(derived), TRACKED)
