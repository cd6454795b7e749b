"""Resolution, derivation, coverage."""

import json

from pyspark.sql import functions as F

from studylake.checks.queries_f import _PARSE
from studylake.checks.registry import REGISTRY, check
from studylake.checks.sqltext import quote
from studylake.functions import dates as DT
from studylake.functions.fixed import COUNTRY_LANGUAGES, LABEL_DEFAULTS
from studylake.functions.text import repaired
from studylake.operators import countries as C
from studylake.operators import fields as R
from studylake.operators import resolve as H
from studylake.operators import schedule as D
from studylake.operators.structure import join_lines
from studylake.sources import readers as RD
from studylake.sources import sinks as K

_RES = "r as (select doc_id, field, value, source, layer, tier, row_number() over (partition by doc_id, field order by layer, tier, value) as k from candidate where value is not null and trim(value) <> '')"


@check("h1_resolve", f"with {_RES} select doc_id, field, value, source, layer, tier from r where k = 1", "candidate")
def _(t):
    return H.resolve(t.candidate)


@check(
    "h2_flatten_overrides",
    "select doc_id, 'Title' as field, pval as value from override_src union all select doc_id, 'Phase', coalesce(flat, status) from override_src",
    "override_src",
)
def _(t):
    pair = lambda f, c: F.struct(F.lit(f).alias("field"), F.col(c).alias("value"))
    flat = F.when(F.col("flat").isNotNull(), F.create_map(F.lit("Phase"), F.col("flat"), F.lit("schema_version"), F.lit("4"))).otherwise(
        F.create_map(F.lit("schema_version"), F.lit("4"))
    )
    return H.flatten_overrides(t.override_src.select("doc_id", F.array(pair("Title", "status"), pair("Phase", "status"), pair("Title", "pval")).alias("lists"), flat.alias("flat")))


CATALOG = [
    {"field": "Title", "source_type": "direct", "source": "PT.title"},
    {"field": "Phase", "source_type": "conditional_fallback", "primary": "DESIGN.phase", "fallback": "PT.phase"},
    {"field": "Immunogenicity", "source_type": "conditional_fallback", "primary": "DESIGN.flag", "fallback": "PT.title", "primary_value_if_truthy": "Yes"},
    {"field": "Countries", "source_type": "mixed_list", "source": "DESIGN.countries"},
    {"field": "Contact", "source_type": "other"},
]


def _records(t):
    record = F.parse_json(
        F.concat(
            F.lit('{"PT": {"title": "T'), "o_custkey", F.lit('", "phase": "2"}, "DESIGN": {'),
            F.when(F.col("o_orderkey") % 2 == 0, '"phase": "3", ').otherwise(""),
            F.lit('"flag": '), (F.col("o_orderkey") % 3 == 0).cast("string"), F.lit("}}"),
        )
    )
    values = F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("Title"), F.col("o_orderpriority"))).otherwise(
        F.create_map(F.lit("Other"), F.lit("x"))
    )
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), record.alias("record"), values.alias("values"))


@check(
    "h3_render_catalog",
    """select o_orderkey as doc_id, 0 as ord, 'Title' as field, case when o_orderkey % 5 = 0 then o_orderpriority else 'T' || o_custkey end as value from orders
    union all select o_orderkey, 1, 'Phase', case when o_orderkey % 2 = 0 then '3' else '2' end from orders union all select o_orderkey, 2, 'Immunogenicity', case when o_orderkey % 3 = 0 then 'Yes' else 'T' || o_custkey end from orders
    union all select o_orderkey, 3, 'Countries', null from orders union all select o_orderkey, 4, 'Contact', null from orders""",
)
def _(t):
    return H.render_catalog(_records(t), CATALOG).drop("source_type")


@check("h4_resolve_path", "select o_orderkey as doc_id, 'T' || o_custkey as title, case when o_orderkey % 2 = 0 then '3' end as phase, cast(null as varchar) as missing from orders")
def _(t):
    path = lambda p: H.resolve_path(F.col("record"), p)
    return _records(t).select("doc_id", path("PT.title").alias("title"), path("DESIGN.phase").alias("phase"), path("DESIGN.phase.deep").alias("missing"))


@check(
    "h5_defaults_applied",
    f"""select c.doc_id, case when {" or ".join(f"regexp_matches(text, {quote(p)})" for p in C.FIRST_VISIT)} then null else 'US' end as country_default, case when strict_rate is null then '30%' end as screen_fail_rate_default
    from country_text c join ({REGISTRY["f22_screen_fail_rate"].sql}) f on f.doc_id = c.doc_id""",
    "country_text",
)
def _(t):
    docs = repaired(t.country_text).select("doc_id", C.initial_country(F.col("text")).alias("initial_country")).join(
        repaired(t.fact_sheet).select("doc_id", R.screen_fail_rate_strict(F.col("text")).alias("screen_fail_rate")), "doc_id"
    )
    return H.defaults_applied(docs)


@check("h6_screened_count", "select o_orderkey as doc_id, case when enrolled > 0 then cast(round_even(enrolled / (1 - rate), 0) as bigint) end as screened from (select o_orderkey, cast(floor(o_totalprice / 1000) as int) as enrolled, cast((o_orderkey % 90) / 100.0 as double) as rate from orders) t")
def _(t):
    rate = (F.col("o_orderkey") % 90 / F.lit(100)).cast("double")
    enrolled = F.floor(F.col("o_totalprice") / 1000).cast("int")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), H.screened_count(enrolled, rate).alias("screened"))


@check(
    "h7_allocate_by_country",
    "select doc_id, abbreviation, pct, cast(round_even(s * pct, 0) as bigint) as screened, cast(round_even(e * pct, 0) as bigint) as randomized from (select *, case when enrolled > 0 then round_even(enrolled / (1 - 0.3::double), 0) end as s, case when enrolled > 0 then enrolled end as e from allocation) a",
    "allocation",
)
def _(t):
    return H.allocate_by_country(t.allocation)


_DATES = f"d as (select doc_id, cast({_PARSE.format('first_visit')} as date) as f, cast({_PARSE.format('last_visit')} as date) as l from date_text)"


def _dates(t):
    return t.date_text.select("doc_id", DT.parse_date_any(F.col("first_visit")).alias("f"), DT.parse_date_any(F.col("last_visit")).alias("l"))


@check(
    "h8_duration_months",
    f"with {_DATES} select doc_id, round_even(date_diff('day', f, l + 28) / 30.4375::double, 1) as months_exact, (year(l) - year(f)) * 12 + month(l) - month(f) + 2 as months_calendar from d",
    "date_text",
)
def _(t):
    return _dates(t).select(
        "doc_id",
        DT.months_exact(F.col("f"), F.date_add("l", 28)).alias("months_exact"),
        DT.months_calendar(F.col("f"), F.col("l")).alias("months_calendar"),
    )


@check(
    "h9_date_offsets",
    f"with {_DATES} select doc_id, cast(cast(f - 14 as date) as varchar) as initiation, cast(cast(f - 21 as date) as varchar) as training, cast(cast(l + 28 as date) as varchar) as closing, strftime(f - 14, '%-d-%B-%Y') as written from d",
    "date_text",
)
def _(t):
    iso = lambda c, n: c.cast("string").alias(n)
    return _dates(t).select(
        "doc_id", iso(F.date_sub("f", 14), "initiation"), iso(F.date_sub("f", 21), "training"), iso(F.date_add("l", 28), "closing"),
        DT.long_date(F.date_sub("f", 14)).alias("written"),
    )


@check(
    "h10_add_business_days",
    "with u as (select doc_id, day, unnest(generate_series(1, 20)) as i from date_text), w as (select doc_id, day, i, row_number() over (partition by doc_id order by i) as n from u where dayofweek(day + i::int) not in (0, 6)) select doc_id, cast(cast(day + i::int as date) as varchar) as due from w where n = 10",
    "date_text",
)
def _(t):
    return t.date_text.select("doc_id", DT.add_business_days(F.col("day"), 10).cast("string").alias("due"))


_LANGS = "(values " + ", ".join(f"({quote(k)}, {quote(w)})" for k, v in COUNTRY_LANGUAGES.items() for w in v) + ") v(abbreviation, language)"


@check("h11_translation_languages", f"select distinct doc_id, language from allocation a join {_LANGS} on a.abbreviation = v.abbreviation", "allocation")
def _(t):
    return C.translation_languages(t.allocation)


@check(
    "h12_rule_visits",
    "with v as (select o_orderkey as doc_id, cast(floor(o_totalprice / 1000) as int) as e, count(l_linenumber) as n from orders left join item on o_orderkey = l_orderkey and l_returnflag = 'R' group by all) select doc_id, case when e > 0 and n > 0 then cast(round_even(e * n * 0.02::double, 0) as bigint) end as visits from v",
    "item",
)
def _(t):
    n = t.item.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    e = F.floor(F.col("o_totalprice") / 1000).cast("int")
    return t.orders.join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("doc_id"), H.rule_visits(e, F.coalesce("n", F.lit(0))).alias("visits"))


@check(
    "h13_derived_flags",
    """with c as (select doc_id, bool_or(abbreviation = 'China') as cn, bool_or(abbreviation = 'US') as us from allocation group by doc_id),
    d as (select o_orderkey as doc_id, case o_orderkey % 5 when 0 then true when 1 then false when 2 then o_orderkey % 30 < 18 end as p0, case o_orderkey % 7 when 0 then 'Yes' when 1 then 'no' end as po, o_orderkey % 2 = 0 as onc, o_orderkey % 11 = 0 as oo from orders),
    e as (select d.doc_id, case when po = 'Yes' then true when po = 'no' then false else p0 end as p, case when oo then false else onc end as o, coalesce(cn, false) as cn, coalesce(us, false) as us from d left join c on d.doc_id = c.doc_id)
    select doc_id, case when p then 'Yes' when not p then 'No' else 'undetermined' end as pediatric, case when o then 'Yes' else 'No' end as oncology, case when coalesce(p, false) or cn then 'Yes' else 'No' end as blood_volume, case when o and us then 'Yes' else 'No' end as us_oncology from e""",
    "allocation",
)
def _(t):
    k = F.col("o_orderkey")
    docs = t.orders.select(
        k.alias("doc_id"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("is_pediatric"),
        F.when(k % 5 == 2, k % 30).alias("min_age"),
        (k % 2 == 0).alias("is_oncology"),
        F.when(k % 7 == 0, "Yes").when(k % 7 == 1, "no").alias("pediatric_override"),
        F.when(k % 11 == 0, "No").alias("oncology_override"),
    )
    return H.derived_flags(docs, t.allocation.withColumnRenamed("abbreviation", "name"))


TRACKED = {
    "alias": ("Protocol alias", "protocol"),
    "phase": ("Phase", "protocol"),
    "area": ("Therapeutic Area", "design"),
    "enrolled": ("Patients enrolled (randomized)", "design"),
    "screened": ("Patients screened", "computed (screen-fail rate)"),
    "min_age": ("Minimum age", "protocol"),
}


def findings(t):
    """Facts of each sheet, as tracked findings: the flagship document job."""
    text = F.col("text")
    facts = repaired(t.fact_sheet).select(
        "doc_id",
        R.protocol_number(text).alias("alias"),
        R.phase(text).alias("phase"),
        F.coalesce(R.area_by_label(text), R.area_by_keyword(text)).alias("area"),
        R.enrollment_first(text).alias("enrolled"),
        R.screen_fail_rate_strict(text).alias("rate"),
        R.min_age(text).alias("min_age"),
    )
    return H.to_findings(facts.withColumn("screened", H.screened_count(F.col("enrolled"), F.coalesce("rate", F.lit(0.30)))), TRACKED)


_FIND = "fnd as (select doc_id, field, value, case when value is null then 'review' when layer = 3 then 'computed' else 'filled' end as status from (select c.doc_id, c.field, r.value, r.layer from (select distinct doc_id, field from candidate) c left join (select * from r where k = 1) r on c.doc_id = r.doc_id and c.field = r.field) x)"


def _found(t):
    best = H.resolve(t.candidate)
    status = F.when(F.col("value").isNull(), "review").when(F.col("layer") == 3, "computed").otherwise("filled")
    return t.candidate.select("doc_id", "field").distinct().join(best, ["doc_id", "field"], "left").withColumn("status", status)


def _findings_sql() -> str:
    part = lambda name, columns, key="doc_id": f"(select {key}, {columns} from ({REGISTRY[name].sql}) q)"
    facts = [
        part("f2_protocol_number", "protocol_number as alias"), part("f5_phase", "phase"), part("f6_area_by_label", "area as label_area"),
        part("f7_area_by_keyword", "area as word_area", "doc_id - 1000000 as doc_id"), part("f9_enrollment_first", "enrolled"), part("f22_screen_fail_rate", "strict_rate"), part("f17_min_age", "min_age"),
    ]
    exprs = {c: c for c in TRACKED} | {
        "area": "coalesce(label_area, word_area)", "screened": "case when enrolled > 0 then cast(round_even(enrolled / (1 - coalesce(strict_rate, 0.3::double)), 0) as bigint) end",
    }
    rows = ", ".join(f"{{'ord': {i}, 'field': {quote(n)}, 'value': nullif(trim(cast({exprs[c]} as varchar)), ''), 'source': {quote(src)}}}" for i, (c, (n, src)) in enumerate(TRACKED.items()))
    joins = " ".join(f"left join {f} p{i} using (doc_id)" for i, f in enumerate(facts))
    return f"""select doc_id, r.ord as ord, r.field as field, r.value as value, r.source as source, case when r.value is null then 'review' when r.source like 'computed%' then 'computed' else 'filled' end as status
    from (select doc_id, unnest([{rows}]) as r from (select doc_id from fact_sheet) b {joins}) x"""


@check("h14_to_findings", _findings_sql(), "fact_sheet")
def _(t):
    return findings(t)


@check(
    "h14_findings_of_studies",
    """select c_custkey as doc_id, 0 as ord, 'Area' as field, c_mktsegment as value, 'extract' as source, 'filled' as status from customer
    union all select c_custkey, 1, 'Segment note', case when c_custkey % 3 = 0 then 'n' || c_custkey end, 'computed (note)', case when c_custkey % 3 = 0 then 'computed' else 'review' end from customer""",
)
def _(t):
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), "c_custkey")).otherwise(" ")
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("area"), note.alias("note"))
    return H.to_findings(docs, {"area": ("Area", "extract"), "note": ("Segment note", "computed (note)")})


@check(
    "h15_coverage",
    f"with {_RES}, {_FIND} select doc_id, count(*) filter (where status = 'filled') as filled, count(*) filter (where status = 'computed') as computed, count(*) filter (where status = 'review') as review, count(*) as total from fnd group by doc_id",
    "candidate",
)
def _(t):
    return H.coverage(_found(t))


@check("h15_corpus_coverage", f"with {_RES}, {_FIND} select field, status, count(*) as n from fnd group by rollup (field, status)", "candidate")
def _(t):
    return H.corpus_coverage(_found(t))


@check(
    "a8_write_report",
    f"""with {_RES}, {_FIND}, l as (select doc_id, field, '| ' || field || ' | ' || coalesce(value, '') || ' | s/' || status || ' | ' || status || ' |' as line, status from fnd)
    select doc_id, '**Coverage:** ' || count(*) filter (where status = 'filled') || ' filled · ' || count(*) filter (where status = 'computed') || ' computed · ' || count(*) filter (where status = 'review') || ' need review (of ' || count(*) || ' tracked items)' || chr(10) || chr(10) || '| Field | Value | Source | Status |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(line, chr(10) order by field) as report from l group by doc_id""",
    "candidate",
)
def _(t):
    rows = _found(t).select("doc_id", F.col("field").alias("ord"), "field", "value", F.concat(F.lit("s|"), "status").alias("source"), "status")
    return K.write_report(rows, H.coverage(rows))


SCHEMA = {
    "type": "object",
    "required": ["study"],
    "properties": {
        "study": {
            "type": "object",
            "required": ["alias"],
            "additionalProperties": False,
            "properties": {
                "alias": {"type": "string"},
                "phase": {"anyOf": [{"type": "string", "enum": ["1", "2", "3"]}, {"type": "null"}]},
                "sites": {"type": "array", "items": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "kind": {"type": "string", "enum": ["main", "side"]}}}},
            },
        },
        "note": {"type": "string", "description": "free text"},
    },
}


# Schemas of the orders: unions either way round, arrays of objects, nesting of several levels, names from the data.
_SCHEMA_TEXT = """select o_orderkey as schema_id, concat('{"type":"object","required":["study","o', o_custkey, '"],"properties":{"study":{"required":["alias"],"properties":{"alias":{"type":"string"},"phase":{"anyOf":[{"type":"null"},{"type":"string","enum":["', o_orderstatus, '","2"]}]},',
 '"sites":{"oneOf":[{"type":"array","items":{"type":"object","required":["name"],"properties":{"name":{"type":"string"},"deep":{"type":"object","properties":{"x":{}}}}}},{"type":"null"}]},',
 '"stage":{"type":"object","required":["', o_orderpriority, '"],"properties":{"', o_orderpriority, '":{"type":"integer","nullable":true},"more":{"type":"object","properties":{"last":{"type":"array","items":{"type":"string"}}}}}}}},',
 '"o', o_custkey, '":', case when o_orderkey % 3 = 0 then '{"type":"string"}' when o_orderkey % 3 = 1 then '{"type":"object","properties":{}}' else '{"properties":{"v":{"oneOf":[{"type":"null"}]}}}' end, '}}') as json from orders"""
_FLAT = f"""with recursive node as (
 select schema_id, cast(null as varchar) as section, '' as path, 'schema' as within, cast(json as json) as node from ({_SCHEMA_TEXT}) s
 union all select schema_id, section, inner_path, opens, case when opens = 'items' then chosen->'items' else chosen end from (#FIELDS#) f where opens is not null)
select schema_id, section, field_name, type, required, nullable, enum, parent_path from (#FIELDS#) f where opens is null"""
_FIELDS = """select schema_id, case when top then k else section end as section, name as field_name, coalesce(chosen->>'type', 'string') as type, list_contains(needed, k) as required,
 coalesce(cast(given->>'nullable' as boolean), false) or len(list_filter(alts, lambda a: (a->>'type') = 'null')) > 0 as nullable, array_to_string(cast(chosen->'enum' as varchar[]), ';') as enum, path as parent_path, chosen,
 case when top then '' else name end as inner_path, case when within = 'items' then null when coalesce(chosen->>'type', case when top then 'object' end) = 'object' and (chosen->'properties') is not null then 'object'
 when not top and (chosen->>'type') = 'array' and (chosen->'items'->'properties') is not null then 'items' end as opens
 from (select *, within = 'schema' as top, case when path = '' then k when within = 'items' then path || '[].' || k else path || '.' || k end as name, coalesce(list_filter(alts, lambda a: coalesce(a->>'type', '') <> 'null')[1], given) as chosen
 from (select *, list_concat(coalesce(cast(given->'anyOf' as json[]), []), coalesce(cast(given->'oneOf' as json[]), [])) as alts
 from (select *, coalesce(cast(node->'required' as varchar[]), []) as needed, node->'properties'->k as given from (select *, unnest(json_keys(node->'properties')) as k from node) a) b) c) d"""
_FLAT = _FLAT.replace("#FIELDS#", _FIELDS)


def _schemas(t):
    t.orders.createOrReplaceTempView("orders")
    return H.flatten_schemas(t.spark.sql(_SCHEMA_TEXT))


@check("h16_flatten_schema", _FLAT)
def _(t):
    return _schemas(t).withColumn("enum", F.array_join("enum", ";"))


@check("h16_schema_summary", f"select schema_id, section, count(*) as fields, count(*) filter (where required) as required from ({_FLAT}) x group by schema_id, section")
def _(t):
    return H.schema_summary(_schemas(t))


def _json_records(t):
    k = F.col("o_orderkey")
    study = F.concat(
        F.when(k % 4 == 0, '"alias": null').when(k % 4 == 1, F.concat(F.lit('"alias": "A'), k, F.lit('"'))).otherwise('"alias": "B"'),
        F.when(k % 3 == 0, ', "phase": "9"').when(k % 3 == 1, ', "phase": null').otherwise(""),
        F.when(k % 5 == 0, ', "sites": [{"name": "x", "kind": "main"}, {"kind": "odd"}]').when(k % 5 == 1, ', "sites": "none"').otherwise(', "sites": []'),
        F.when(k % 7 == 0, ', "extra": 1').otherwise(""),
    )
    json = F.concat(F.lit('{"study": {'), study, F.lit("}"), F.when(k % 2 == 0, ', "note": "n"').otherwise(""), F.lit("}"))
    return t.orders.select(k.alias("doc_id"), json.alias("json"))


@check(
    "h17_validate_records",
    """with k as (select o_orderkey as k from orders)
    select k as doc_id, 'Required field missing/null: .study.alias' as error from k where k % 4 = 0
    union all select k, 'Invalid value ''9'' at .study.phase: must be one of [''1'', ''2'', ''3'']' from k where k % 3 = 0 union all select k, 'Missing field: .study.phase' from k where k % 3 = 2
    union all select k, unnest(['Missing field: .study.sites[1].name', 'Required field missing/null: .study.sites[1].name', 'Invalid value ''odd'' at .study.sites[1].kind: must be one of [''main'', ''side'']']) from k where k % 5 = 0
    union all select k, 'Expected array at .study.sites' from k where k % 5 = 1 union all select k, 'Extra field: .study.extra' from k where k % 7 = 0 union all select k, 'Missing field: .note' from k where k % 2 = 1""",
)
def _(t):
    return H.validate_records(_json_records(t), SCHEMA)


@check("h18_empty_record", """select o_orderkey as doc_id, '{"study":{"sites":[]}}' as record from orders""")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.to_json(H.empty_record(SCHEMA)).alias("record"))


RULES = {
    "Pediatric Considerations": ("pediatric", "unless_no"),
    "Decentralized Trials": ("decentralized", "yes"),
    "Anatomic Pathology": ("pathology", "yes"),
    "Hepatic: Non-oncology": ("hepatic", "non-oncology"),
    "Hepatic: Oncology - with ICI": ("hepatic", "oncology - with ici"),
}
_ANSWERS = "select o_orderkey as doc_id, case o_orderkey % 3 when 0 then 'No' when 1 then 'Yes' end as pediatric, case when o_orderkey % 4 = 0 then 'yes' end as decentralized, case when o_orderkey % 5 = 0 then 'Yes' else 'No' end as pathology, case when o_orderkey % 2 = 0 then 'Non-oncology' else 'Oncology - with ICI' end as hepatic from orders"


def _answers(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("doc_id"),
        F.when(k % 3 == 0, "No").when(k % 3 == 1, "Yes").alias("pediatric"),
        F.when(k % 4 == 0, "yes").alias("decentralized"),
        F.when(k % 5 == 0, "Yes").otherwise("No").alias("pathology"),
        F.when(k % 2 == 0, "Non-oncology").otherwise("Oncology - with ICI").alias("hepatic"),
    )


@check(
    "h19_applicable_sections",
    f"""with a as ({_ANSWERS}) select doc_id, 'Pediatric Considerations' as section from a where pediatric is null or pediatric <> 'No' union all select doc_id, 'Decentralized Trials' from a where decentralized = 'yes'
    union all select doc_id, 'Anatomic Pathology' from a where pathology = 'Yes' union all select doc_id, 'Hepatic: ' || hepatic from a""",
)
def _(t):
    return H.applicable_sections(_answers(t), RULES)


_LABELS = """select l_orderkey as doc_id, l_linenumber as row_no, case l_partkey % 9 when 0 then 'Kit overage assumed' when 1 then 'Sample metadata / Kit overage' when 2 then 'Weekend pick-up' when 3 then 'data transfer to LabsConnect' else l_returnflag end as label from item"""


@check(
    "h20_label_defaults",
    f"with l as ({_LABELS}) select * from (select *, case " + " ".join(f"when contains(lower(label), {quote(k.lower())}) then {quote(v)}" for k, v in LABEL_DEFAULTS) + ' end as "default" from l) d where "default" is not null',
    "item",
)
def _(t):
    p = F.col("l_partkey") % 9
    label = F.when(p == 0, "Kit overage assumed").when(p == 1, "Sample metadata / Kit overage").when(p == 2, "Weekend pick-up").when(p == 3, "data transfer to LabsConnect").otherwise(F.col("l_returnflag"))
    return H.label_defaults(t.item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_no"), label.alias("label")))


@check(
    "h21_answers_record",
    f"with a as ({_ANSWERS}), u as (select doc_id, unnest(['pediatric', 'decentralized', 'pathology', 'hepatic']) as field, unnest([pediatric, decentralized, pathology, hepatic]) as value from a) select doc_id, field, value, 0 as layer from u where value is not null",
)
def _(t):
    return H.answers_record(_answers(t), ["pediatric", "decentralized", "pathology", "hepatic"])


@check("a4_read_field_catalog")
def _(t):
    """The catalog file against the candidates: how many values each catalog field has."""
    from uuid import uuid4

    from studylake.functions.stage import shared_folder

    doc = {"protocol_fields": [{"field": f"field{i}", "source_type": "direct", "source": f"PT.f{i}"} for i in range(3)], "design_fields": [{"field": "field3", "source_type": "mixed_list", "source": "D.x", "match_phrases": ["a", "b"]}], "rfp_engine_fields": {"fields": [{"field": "made", "source_type": "direct", "source": "E.m"}]}}
    path = f"{shared_folder(t.spark)}/catalog-{uuid4().hex}"
    t.spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(path)
    catalog = RD.read_field_catalog(t.spark, path)
    counts = t.candidate.groupBy("field").agg(F.count("value").alias("values"))
    return catalog.join(counts, "field", "left").drop("match_phrases")
