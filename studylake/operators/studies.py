"""The study extract: base rows joined with packed countries, enrollment and milestones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phases, yes/no words, milestone types and output columns.
PHASES = {"i": "I", "ii": "II", "iii": "III", "iv": "IV", "1": "I", "2": "II", "3": "III", "4": "IV"}
YES, NO = ("y", "yes", "true", "1"), ("n", "no", "false", "0")
MILESTONE_TYPES = {
    "pa_date": "Protocol Approval",
    "fpv_date": "First Patient Visit",
    "lpv_primary": "Primary Outcome Last Patient Visit",
    "lpv_all": "All Outcomes LPV",
    "fpet_date": "First Patient Entered Treatment",
    "lpet_date": "Last Patient Entered Treatment",
}


def normalize_phase(raw: Column) -> Column:
    """``Phase 3``, ``phase II`` or a bare token as a roman numeral, else null."""
    word = r"(?i)phase\s*([ivx1-4]+)"
    token = F.lower(F.trim(F.when(raw.rlike(word), F.regexp_extract(raw, word, 1)).otherwise(raw)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), token)


def yes_no(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin(*YES), "Yes").when(word.isin(*NO), "No")


def pack_countries(country: DataFrame) -> DataFrame:
    """``(alias, countries)``: ``name|abbr|status`` of each country row, joined by ``;;``. Equal
    rows are counted before the shuffle, so what is collected per study is bounded by the
    number of distinct countries and states."""
    parts = [F.coalesce(c, F.lit("")).alias(c) for c in ("country", "abbr", "status")]
    counted = country.select("alias", *parts).groupBy("alias", "country", "abbr", "status").agg(F.count("*").cast("int").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct("country", "abbr", "status", "n")))
    packed = F.transform(rows, lambda r: F.array_repeat(F.concat_ws("|", r["country"], r["abbr"], r["status"]), r["n"]))
    return counted.groupBy("alias").agg(F.array_join(F.flatten(packed), ";;").alias("countries"))


def unpack_countries(extract: DataFrame) -> DataFrame:
    """``(alias, name, abbreviation, status)`` per country; nameless groups are dropped."""
    part = lambda i: F.nullif(F.try_element_at("_p", F.lit(i)), F.lit(""))
    groups = extract.select("alias", F.explode(F.split("countries", ";;")).alias("_g"))
    parts = groups.select("alias", F.split("_g", r"\|").alias("_p"))
    return parts.select(
        "alias", part(1).alias("name"), part(2).alias("abbreviation"), part(3).alias("status")
    ).where(F.col("name").isNotNull())


def pivot_enrollment(enrollment: DataFrame) -> DataFrame:
    """``(alias, enrolled, screened)`` of planned totals; the highest wins repeats."""
    total = lambda kind: F.max(F.when(F.col("enrollment_type") == kind, F.col("total")))
    return (
        enrollment.where(F.col("total").isNotNull() & F.col("enrollment_type").isin("Enrolled", "Screened"))
        .groupBy("alias")
        .agg(total("Enrolled").alias("enrolled"), total("Screened").alias("screened"))
    )


def pivot_milestones(milestone: DataFrame) -> DataFrame:
    """One date column per milestone type; the latest date wins repeats."""
    known = milestone.where(F.col("milestone_type").isNotNull() & F.col("milestone_date").isNotNull())
    return known.groupBy("alias").agg(
        *[F.max(F.when(F.col("milestone_type") == t, F.col("milestone_date"))).alias(n) for n, t in MILESTONE_TYPES.items()]
    )


def coalesce_milestone(pivoted: DataFrame) -> DataFrame:
    """Last visit: the primary-outcome date, else the all-outcomes date."""
    return pivoted.withColumn("lpv_date", F.coalesce("lpv_primary", "lpv_all")).drop("lpv_primary", "lpv_all")


def assemble_studies(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per study. Side tables are reduced to one row per study before they are joined,
    so no join sees a hot key; the join strategy follows their measured size."""
    base = tables["study"].groupBy("alias").agg(F.max(F.struct("phase_raw", "area", "pediatric_raw")).alias("s"))
    studies = base.select(
        "alias",
        F.coalesce(normalize_phase(F.col("s.phase_raw")), F.lit("")).alias("phase"),
        F.coalesce("s.area", F.lit("")).alias("area"),
        F.coalesce(yes_no(F.col("s.pediatric_raw")), F.lit("")).alias("pediatric"),
    )
    dates = ("pa_date", "fpv_date", "lpv_date", "fpet_date", "lpet_date")
    return (
        studies.join(pack_countries(tables["country"]), "alias", "left")
        .join(pivot_enrollment(tables["enrollment"]), "alias", "left")
        .join(coalesce_milestone(pivot_milestones(tables["milestone"])), "alias", "left")
        .select("alias", "phase", "area", "pediatric", F.coalesce("countries", F.lit("")).alias("countries"), "enrolled", "screened", *dates)
    )


def new_rows(rows: DataFrame, stored: DataFrame, key: str, first_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is not stored. Of several rows with one key the first by ``first_by`` is kept (ties: the
    smallest row), without an order the largest row, so that a retry keeps the same."""
    row = F.struct(*rows.columns)
    kept = F.min(F.struct(F.struct(*first_by).alias("o"), row.alias("r")))["r"] if first_by else F.max(row)
    one = rows.groupBy(F.col(key).alias("__key")).agg(kept.alias("__row")).select("__row.*")
    return one.join(stored.select(key), key, "left_anti").select(rows.columns)


def run_summary(rows: DataFrame, stored: DataFrame, key: str = "alias") -> DataFrame:
    """``(added, total_in_source, total_in_file)`` of an incremental run."""
    source = rows.select(key).distinct().withColumn("_src", F.lit(1))
    known = stored.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct().withColumn("_old", F.lit(1))
    both = source.join(known, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_old").isNull()).alias("added"),
        F.count("_src").alias("total_in_source"),
        F.count("*").alias("total_in_file"),
    )


def lookup_fields(requested: DataFrame, extract: DataFrame) -> DataFrame:
    """``(alias, status, fields, milestones)`` for requested aliases: the non-blank fields of the
    stored row, and the milestone struct if any date is set."""
    hit = requested.select("alias").distinct().join(extract.withColumn("_hit", F.lit(True)), "alias", "left")
    names = {
        "Phase": "phase",
        "Therapeutic Area": "area",
        "Pediatric population?": "pediatric",
        "Countries in scope": "countries",
        "Patients enrolled (randomized)": "enrolled",
        "Patients screened": "screened",
        "Protocol Approval (PA) date": "pa_date",
        "Planned First Patient Visit (FPV) date": "fpv_date",
        "Planned Last Patient Visit (LPV) date": "lpv_date",
    }
    pairs = F.create_map(*[x for label, c in names.items() for x in (F.lit(label), F.col(c).cast("string"))])
    dates = ("pa_date", "fpv_date", "lpv_date", "fpet_date", "lpet_date")
    return hit.select(
        "alias",
        F.when(F.col("_hit"), "ok").otherwise("not_found").alias("status"),
        F.when(F.col("_hit"), F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))).alias("fields"),
        F.when(F.coalesce(*dates).isNotNull(), F.struct(*dates)).alias("milestones"),
    )


def fill_from_extract(extracted: DataFrame, looked_up: DataFrame) -> DataFrame:
    """``(doc_id, alias, field, value, source)``: extract fields overwrite those read from the
    document with the same alias, and are added where the document had none."""
    stored = looked_up.select("alias", F.explode("fields").alias("field", "_stored"))
    docs = extracted.select("doc_id", "alias").distinct().join(stored, "alias")
    merged = extracted.join(docs, ["doc_id", "alias", "field"], "full_outer")
    return merged.select(
        "doc_id",
        "alias",
        "field",
        F.coalesce("_stored", "value").alias("value"),
        F.when(F.col("_stored").isNotNull(), "extract").otherwise("text").alias("source"),
    )
