"""Field values: precedence of sources, derived values, findings and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studylake.functions.fixed import LABEL_DEFAULTS
from studylake.functions.stage import stage

# Keys of a structured override that are no fields.
META_KEYS = ("protocol_fields", "design_fields", "rfp_engine_fields", "schema_version", "defaults_applied", "intermediate")


def resolve(candidates: DataFrame) -> DataFrame:
    """``(doc_id, field, value, source, layer, tier)``: per field the non-blank candidate of the
    lowest layer, then tier. ``min_by`` combines map-side, so hot fields do not pile up."""
    best = F.min_by(F.struct("value", "source", "layer", "tier"), F.struct("layer", "tier", "value"))
    kept = candidates.where(F.col("value").isNotNull() & (F.trim("value") != ""))
    return kept.groupBy("doc_id", "field").agg(best.alias("b")).select("doc_id", "field", "b.*")


def flatten_overrides(overrides: DataFrame) -> DataFrame:
    """``(doc_id, field, value)`` from ``lists`` (array of field/value) and ``flat`` (map); a flat
    key wins, meta keys are ignored, and of repeated list entries the last counts."""
    listed = overrides.select("doc_id", F.posexplode("lists").alias("_i", "s")).select(
        "doc_id", "s.field", "s.value", (F.col("_i") + 1).alias("_rank")
    )
    flat = overrides.select("doc_id", F.explode("flat").alias("field", "value"), F.lit(1 << 30).alias("_rank"))
    both = listed.unionByName(flat).where(~F.col("field").isin(*META_KEYS))
    return both.groupBy("doc_id", "field").agg(F.max_by(F.struct("value"), "_rank")["value"].alias("value"))


def resolve_path(record: Column, path: str) -> Column:
    """Text at a dotted path of a VARIANT record; null when any step is missing."""
    return F.try_variant_get(record, "$." + path, "string") if path else F.lit(None).cast("string")


def render_catalog(docs: DataFrame, catalog: Sequence[Mapping[str, str]]) -> DataFrame:
    """``(doc_id, ord, field, source_type, value)``: one row per catalog field and document. The
    value by field name, else by the field's source in the record. ``docs`` has ``values`` (map)
    and ``record`` (VARIANT); the catalog is a small list and stays in the plan."""

    def fallback(spec: Mapping[str, str]) -> Column:
        kind, get = spec.get("source_type"), lambda k: resolve_path(F.col("record"), spec.get(k) or "")
        if kind == "conditional_fallback":
            primary = get("primary")
            truthy = primary.isNotNull() & ~primary.isin("", "false", "0")
            fixed = spec.get("primary_value_if_truthy")
            return F.when(truthy, F.lit(fixed) if fixed else primary).otherwise(get("fallback"))
        if kind in ("direct", "mixed_list", "object_passthrough_with_validation", "range_or_scenario"):
            return get("source")
        return F.lit(None).cast("string")

    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(spec["field"]).alias("field"),
            F.lit(spec.get("source_type")).alias("source_type"),
            F.coalesce(F.try_element_at("values", F.lit(spec["field"])), fallback(spec)).alias("value"),
        )
        for i, spec in enumerate(catalog)
    ]
    return docs.select("doc_id", F.inline(F.array(*rows)))


def defaults_applied(docs: DataFrame) -> DataFrame:
    """Which defaults were used: ``docs`` has ``initial_country`` and ``screen_fail_rate``, null if
    not found."""
    return docs.select(
        "doc_id",
        F.when(F.col("initial_country").isNull(), "US").alias("country_default"),
        F.when(F.col("screen_fail_rate").isNull(), "30%").alias("screen_fail_rate_default"),
    )


# --- derived values -----------------------------------------------------------------------------


def screened_count(enrolled: Column, rate: Column) -> Column:
    """Participants to screen; halves round to even. Null without an enrolled number."""
    return F.when(enrolled > 0, F.bround(enrolled / (1 - rate), 0).cast("bigint"))


def allocate(total: Column, pct: Column) -> Column:
    return F.when(total > 0, F.bround(total * pct, 0).cast("bigint"))


def allocate_by_country(countries: DataFrame, rate: float = 0.30) -> DataFrame:
    """Screened and randomised participants of each country from its target share."""
    return countries.select(
        "doc_id",
        "abbreviation",
        "pct",
        allocate(screened_count(F.col("enrolled"), F.lit(rate)), F.col("pct")).alias("screened"),
        allocate(F.col("enrolled"), F.col("pct")).alias("randomized"),
    )


def rule_visits(enrolled: Column, visits: Column) -> Column:
    """Expected visits at two per cent; null if either number is missing or zero."""
    return F.when((enrolled > 0) & (visits > 0), F.bround(enrolled * visits * 0.02, 0).cast("bigint"))


def derived_flags(docs: DataFrame, countries: DataFrame) -> DataFrame:
    """``docs``: ``is_pediatric`` (null if unset), ``min_age``, ``is_oncology`` and optional answers
    ``pediatric_override``, ``oncology_override`` (yes/no). Countries need ``doc_id`` and ``name``."""
    low = F.lower(F.trim("name"))
    seen = countries.groupBy("doc_id").agg(
        F.bool_or(low.contains("china")).alias("_china"),
        F.bool_or(low.isin("us", "usa", "u.s.", "u.s.a.") | low.contains("united states")).alias("_us"),
    )
    word = lambda c: F.lower(F.trim(c))
    pediatric = F.when(word("pediatric_override").isin("yes", "no"), word("pediatric_override") == "yes").otherwise(
        F.coalesce("is_pediatric", F.col("min_age") < 18)
    )
    oncology = F.when(word("oncology_override").isin("yes", "no"), word("oncology_override") == "yes").otherwise(F.col("is_oncology"))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")
    return docs.join(seen, "doc_id", "left").select(
        "doc_id",
        F.when(pediatric, "Yes").when(~pediatric, "No").otherwise("undetermined").alias("pediatric"),
        yes(oncology).alias("oncology"),
        yes(F.coalesce(pediatric, F.lit(False)) | F.coalesce("_china", F.lit(False))).alias("blood_volume"),
        yes(oncology & F.coalesce("_us", F.lit(False))).alias("us_oncology"),
    )


# --- findings and coverage -----------------------------------------------------------------------


def to_findings(docs: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(doc_id, ord, field, value, source, status)``: one row per tracked field. ``fields`` maps a
    column to its name and source; columns of source ``computed…`` count as computed, blanks as
    open for review."""
    rows = []
    for i, (column, (name, source)) in enumerate(fields.items()):
        value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
        done = "computed" if source.startswith("computed") else "filled"
        rows.append(
            F.struct(
                F.lit(i).alias("ord"), F.lit(name).alias("field"), value.alias("value"), F.lit(source).alias("source"),
                F.when(value.isNotNull(), done).otherwise("review").alias("status"),
            )
        )
    return docs.select("doc_id", F.inline(F.array(*rows)))


def coverage(findings: DataFrame) -> DataFrame:
    """``(doc_id, filled, computed, review, total)``."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return findings.groupBy("doc_id").agg(n("filled"), n("computed"), n("review"), F.count("*").alias("total"))


def corpus_coverage(findings: DataFrame) -> DataFrame:
    """Counts per field and status, per field, and over all; null stands for the total."""
    counts = findings.groupBy("field", "status").agg(F.count("*").alias("n"))
    return counts.rollup("field", "status").agg(F.sum("n").alias("n"))


# --- schemas ----------------------------------------------------------------------------------------


def _stands_for(node: Mapping) -> Mapping:
    """What a node stands for: of a union its first alternative other than null."""
    alternatives = [*node.get("anyOf", ()), *node.get("oneOf", ())]
    return next((a for a in alternatives if a.get("type") != "null"), node)


def _at(node: str, name: str, kind: str) -> Column:
    return F.try_variant_get(node, f"$.{name}", kind)


def flatten_schemas(schemas: DataFrame) -> DataFrame:
    """Leaf fields of JSON schemas ``(schema_id, json)``: ``(schema_id, section, field_name, type, required, nullable,
    enum, parent_path)``.

    Each step opens the objects found by the step before, until none is left, so nesting is free; the steps' rows are
    stored. Top-level objects are sections. The fields of objects in an array are leaves named ``path[].name``. Texts
    that are no JSON, or without properties, have no leaves.
    """
    open_nodes = schemas.select(
        "schema_id", F.lit(None).cast("string").alias("section"), F.lit("").alias("path"), F.lit("schema").alias("within"),
        F.try_parse_json("json").alias("node"),
    )
    leaves: DataFrame | None = None
    while True:
        fields = stage(_schema_fields(open_nodes))
        found = fields.where("opens is null").select(
            "schema_id", "section", "field_name", "type", "required", "nullable", "enum", "parent_path"
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        open_nodes = fields.where("opens is not null").select(
            "schema_id", "section", F.col("inner_path").alias("path"), F.col("opens").alias("within"), F.col("inner").alias("node")
        )
        if open_nodes.isEmpty():
            return leaves


def _schema_fields(open_nodes: DataFrame) -> DataFrame:
    """The fields of open nodes; ``opens`` tells how a field is to be opened (null: a leaf)."""
    none = F.array().cast("array<variant>")
    alternatives = F.concat(F.coalesce(_at("given", "anyOf", "array<variant>"), none), F.coalesce(_at("given", "oneOf", "array<variant>"), none))
    is_null = lambda a: F.coalesce(F.try_variant_get(a, "$.type", "string") == "null", F.lit(False))
    given = open_nodes.select(
        "schema_id", "section", "path", "within", F.coalesce(_at("node", "required", "array<string>"), F.array().cast("array<string>")).alias("_needed"),
        F.explode(_at("node", "properties", "map<string,variant>")).alias("key", "given"),
    )
    chosen = given.withColumn("_any", alternatives).select(
        "*", F.coalesce(F.get(F.filter("_any", lambda a: ~is_null(a)), F.lit(0)), F.col("given")).alias("inner")
    )
    kind, top, item = _at("inner", "type", "string"), F.col("within") == "schema", F.col("within") == "items"
    has_fields = F.col("inner").isNotNull() & _at("inner", "properties", "map<string,variant>").isNotNull()
    items = _at("inner", "items", "variant")
    rows = ~top & (kind == "array") & _at("inner", "items.properties", "map<string,variant>").isNotNull()
    path = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.when(item, "[].").otherwise("."), "key"))
    opens = F.when(item, None).when(F.coalesce(kind, F.when(top, "object")) == "object", F.when(has_fields, "object")).when(rows, "items")
    return chosen.select(
        "schema_id",
        F.when(top, F.col("key")).otherwise(F.col("section")).alias("section"),
        path.alias("field_name"),
        F.coalesce(kind, F.lit("string")).alias("type"),
        F.array_contains("_needed", F.col("key")).alias("required"),
        (F.coalesce(_at("given", "nullable", "boolean"), F.lit(False)) | F.exists("_any", is_null)).alias("nullable"),
        _at("inner", "enum", "array<string>").alias("enum"),
        F.col("path").alias("parent_path"),
        opens.alias("opens"),
        F.when(top, "").otherwise(path).alias("inner_path"),
        F.when(opens == "items", items).otherwise(F.col("inner")).alias("inner"),
    )


def schema_summary(fields: DataFrame) -> DataFrame:
    """``(schema_id, section, fields, required)``: counts per section."""
    return fields.groupBy("schema_id", "section").agg(F.count("*").alias("fields"), F.count_if("required").alias("required"))


def validate_records(records: DataFrame, schema: Mapping) -> DataFrame:
    """``(doc_id, error)`` for ``json`` records: missing, required, extra, no array, not allowed.
    The checks are one expression per record, unfolded from the schema."""

    def errors(value: Column, node: Mapping, path: Column) -> list[Column]:
        eff = _stands_for(node)
        kind, props = eff.get("type", "string"), eff.get("properties", {})
        out: list[Column] = []
        if kind == "object":
            for key, child in props.items():
                at = F.variant_get(value, f"$.{key}", "variant")
                here = F.concat(path, F.lit(f".{key}"))
                missing = F.array(F.concat(F.lit("Missing field: "), here))
                inner = errors(at, child, here)
                ok = F.concat(*inner) if inner else F.array().cast("array<string>")
                out.append(F.when(at.isNull(), missing).otherwise(ok))
            for key in eff.get("required", []):
                at = F.variant_get(value, f"$.{key}", "variant")
                text = F.concat(F.lit("Required field missing/null: "), path, F.lit(f".{key}"))
                out.append(F.when(at.isNull() | F.is_variant_null(at), F.array(text)).otherwise(F.array().cast("array<string>")))
            if eff.get("additionalProperties") is False:
                known = [*props, *eff.get("required", [])]
                keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
                extra = F.filter(keys, lambda k: ~k.isin(*known)) if known else keys
                out.append(F.transform(extra, lambda k: F.concat(F.lit("Extra field: "), path, F.lit("."), k)))
        elif kind == "array":
            items = eff.get("items", {})
            rows = F.try_variant_get(value, "$", "array<variant>")
            flagged = F.array(F.concat(F.lit("Expected array at "), path))
            if _stands_for(items).get("type") == "object" or "properties" in _stands_for(items):
                each = F.flatten(
                    F.transform(
                        rows,
                        lambda item, i: F.concat(*errors(item, items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))),
                    )
                )
            else:
                each = F.array().cast("array<string>")
            out.append(F.when(rows.isNull(), flagged).otherwise(each))
        elif eff.get("enum"):
            text = F.try_variant_get(value, "$", "string")
            allowed = "['" + "', '".join(eff["enum"]) + "']"
            bad = F.concat(F.lit("Invalid value '"), text, F.lit("' at "), path, F.lit(f": must be one of {allowed}"))
            out.append(F.when(text.isNotNull() & ~text.isin(*eff["enum"]), F.array(bad)).otherwise(F.array().cast("array<string>")))
        return out

    parsed = records.select("doc_id", F.try_parse_json("json").alias("_v"))
    return parsed.select("doc_id", F.explode(F.concat(*errors(F.col("_v"), schema, F.lit("")))).alias("error"))


def struct_of(schema: Mapping) -> T.DataType:
    """Spark type of a JSON schema; leaves are strings."""
    node = _stands_for(schema)
    if node.get("type") == "object" and "properties" in node:
        return T.StructType([T.StructField(k, struct_of(v)) for k, v in node["properties"].items()])
    if node.get("type") == "array":
        return T.ArrayType(struct_of(node.get("items", {"type": "string"})))
    return T.StringType()


def empty_record(schema: Mapping) -> Column:
    """A record shaped by the schema: null leaves, empty arrays."""

    def build(node: Mapping) -> Column:
        eff = _stands_for(node)
        if eff.get("type") == "object" and "properties" in eff:
            return F.struct(*[build(v).alias(k) for k, v in eff["properties"].items()])
        if eff.get("type") == "array":
            return F.array().cast(struct_of(eff))
        return F.lit(None).cast("string")

    return build(schema)


# --- rules on sections and labels ---------------------------------------------------------------------


def applicable_sections(docs: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``(doc_id, section)`` kept by the answers. ``rules`` maps a section to the answer column it
    needs and the value that keeps it; a section without an answer stays only if that value is
    ``unless_no``."""
    rows = []
    for section, (answer, keep) in rules.items():
        given = F.lower(F.trim(F.col(answer).cast("string")))
        kept = F.coalesce(given != "no", F.lit(True)) if keep == "unless_no" else F.coalesce(given == keep.lower(), F.lit(False))
        rows.append(F.when(kept, F.lit(section)))
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("section"))


def label_defaults(labels: DataFrame) -> DataFrame:
    """Adds ``default`` to rows whose label contains a key; the first key in order counts."""
    low = F.lower("label")
    value = F.coalesce(*[F.when(low.contains(k.lower()), v) for k, v in LABEL_DEFAULTS])
    return labels.withColumn("default", value).where(F.col("default").isNotNull())


def answers_record(answers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(doc_id, field, value, layer)``: study answers and manual values as one override layer,
    blanks left out."""
    long = answers.select("doc_id", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ["doc_id"], list(columns), "field", "value"
    )
    return long.where(F.col("value").isNotNull() & (F.trim("value") != "")).withColumn("layer", F.lit(0))


