"""Arriving data, and the whole document run."""

from uuid import uuid4

from pyspark.sql import functions as F

from studylake.checks.queries_c import _ROWS
from studylake.checks.queries_f import _PARSE
from studylake.checks.registry import REGISTRY, check
from studylake.checks.sqltext import extract_, quote, repaired_, squeeze_
from studylake.functions.fixed import COUNTRY_LANGUAGES, MILESTONES
from studylake.functions.stage import shared_folder
from studylake.operators import resolve as H
from studylake.operators.countries import FIRST_VISIT
from studylake.operators.fields import TITLE
from studylake.operators.structure import explode_lines
from studylake.plans import documents as P
from studylake.streaming import jobs as J


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid4().hex}"


@check("l1_stream_append_new", "select distinct alias, 1 as n from enrollment where alias <> ''", "enrollment")
def _(t):
    folder = _folder(t)
    t.enrollment.repartition(4, "enrollment_type").write.parquet(f"{folder}/in")
    rows = J.arriving(t.spark, f"{folder}/in", t.enrollment.schema, 1)
    for _ in range(2):  # the second start finds nothing new
        J.stream_append_new(rows, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("alias").agg(F.count("*").alias("n"))


@check("l2_last_activity", "select user_id, cast(max(ts) as varchar) as last_ts, max(ts) < timestamp '2024-01-20 00:00:00' - interval 6 hours as expired from events group by user_id")
def _(t):
    return J.last_activity(t.events, "2024-01-20 00:00:00").withColumn("last_ts", F.col("last_ts").cast("string"))


_SESSIONS = """with g as (select *, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sn from g) select user_id, cast(min(ts) as varchar) as started, cast(max(ts) + interval 6 hours as varchar) as ended, count(*) as events from s group by user_id, sn"""


@check("l2_idle_sessions", _SESSIONS)
def _(t):
    return J.idle_sessions(t.events).select("user_id", F.col("started").cast("string"), F.col("ended").cast("string"), "events")


_OPEN = _SESSIONS.replace("count(*) as events from s group by", "count(*) as events, max(ts) + interval 6 hours > (select max(ts) from events) as open from s group by")


@check("l2_stream_idle_sessions", _OPEN)
def _(t):
    folder = _folder(t)
    t.events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    rows = J.arriving(t.spark, f"{folder}/in", t.events.schema, 1)
    J.stream_sessions(rows, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    sessions = J.stored_sessions(t.spark, f"{folder}/out")
    return sessions.select("user_id", F.col("started").cast("string"), F.col("ended").cast("string"), "events", "open")


@check(
    "m3_table_facts",
    f"""with {_ROWS}, t as (select doc_id, table_no, max(case when is_header and cells[1] = 'Procedure' then 1 else 0 end) as soa, max(case when is_header and contains(cells[1], 'Clinical') then 1 else 0 end) as lab, count(*) filter (where not is_header) as n from rows_ group by all)
    select s.doc_id, case when s.n = 0 then 1 else 3 end as visits, greatest(s.n, 1) as procedures, greatest(l.n, 1) as analytes from t s join t l on s.doc_id = l.doc_id and s.soa = 1 and l.lab = 1""",
    "cell",
)
def _(t):
    return P.table_facts(t.protocol_line)


# A document: its text (fact_sheet), its lines, its design text (country_text) and its timeline (milestone_text).
def _findings(t):
    return P.document_findings(t.fact_sheet, t.protocol_line, t.country_text, t.milestone_text)


def _of(name: str, *columns: str, shift: int = 0) -> str:
    """A registered query's SQL as a subquery; some count fact sheets from a million on."""
    key = f"doc_id - {shift} as doc_id" if shift else "doc_id"
    return f"(select {', '.join([key, *columns])} from ({REGISTRY[name].sql}) q{f' where doc_id >= {shift}' if shift else ''})"


def _title() -> str:
    tiers = [squeeze_(f"regexp_replace({extract_('text', p)}, 'Commented\\s*\\[[^\\]]*\\]', '', 'g')") for p in TITLE]
    return "coalesce(" + ", ".join(f"case when length({v}) > 20 and length({v}) <= 400 then {v} end" for v in tiers) + ")"


def _findings_sql(tables: bool = True) -> str:
    """``tables``: whether the documents' lines have any."""
    day = lambda k: f"cast({_PARSE.format(k)} as date)"
    parts = [
        _of("f2_protocol_number", "protocol_number as alias"), f"(select doc_id, {_title()} as title from (select doc_id, {repaired_('text')} as text from fact_sheet) d)",
        _of("f3_compound", "compound"), _of("f5_phase", "phase"), _of("f6_area_by_label", "area as label_area"), _of("f7_area_by_keyword", "area as word_area", shift=1000000),
        _of("f8_indication", "indication"), _of("f20_immunogenicity", "immunogenicity as immuno"), _of("f21_genetics", "genetics"), _of("f9_enrollment_first", "enrolled"),
        _of("f22_screen_fail_rate", "strict_rate"), _of("f17_min_age", "min_age"), _of("f18_is_oncology", "is_oncology", shift=1000000),
        _of("f19_has_checkpoint_inhibitor", "has_inhibitor", shift=1000000), _of("f30_not_reported_groups", "nullif(assays, '') as not_reported"), 
        f"(select * from {_of('m3_table_facts', 'visits', 'procedures', 'analytes')} t where {tables})",
        """(select doc_id, trim(coalesce(string_agg(name, ', ' order by name) filter (not consideration), '') || coalesce(' [consideration: ' || (string_agg(name, ', ' order by name) filter (consideration)) || ']', '')) as countries,
          count(*) || ' countries (' || count(*) filter (not consideration) || ' in scope, ' || count(*) filter (consideration) || ' consideration)' as allocation, bool_or(contains(lower(name), 'china')) as china,
          bool_or(lower(trim(name)) in ('us', 'usa', 'u.s.', 'u.s.a.') or contains(lower(name), 'united states')) as us from mentions group by doc_id)""",
        "(select doc_id, string_agg(distinct language, ', ' order by language) as languages from mentions join spoken using (abbreviation) group by doc_id)",
        "(select doc_id, case when matched then country end as initial_country from first_country)",
        f"""(select doc_id, string_agg(milestone || ': ' || value, ', ' order by list_position({[*MILESTONES]}, milestone)) as milestones, max(case when milestone = 'FPV' then {day('value')} end) as first,
          max(case when milestone = 'LPV' then {day('value')} end) as last from {_of("f14_milestones_text", "milestone", "value")} m group by doc_id)""",
    ]
    exprs = {c: c for c in P.TRACKED} | {
        "area": "coalesce(label_area, word_area)", "screened": "case when enrolled > 0 then cast(round_even(enrolled / (1 - coalesce(strict_rate, 0.3::double)), 0) as bigint) end",
        "pediatric": "case when min_age < 18 then 'Yes' when min_age >= 18 then 'No' else 'undetermined' end", "oncology": "case when is_oncology then 'Yes' else 'No' end",
        "inhibitor": "case when has_inhibitor then 'Yes' else 'No' end", "us_oncology": "case when is_oncology and us then 'Yes' else 'No' end", "blood_volume": "case when min_age < 18 or china then 'Yes' else 'No' end",
        "duration": "((year(last) - year(first)) * 12 + month(last) - month(first) + 2) || ' months'", "siv": "strftime(first - interval 14 day, '%-d-%B-%Y')", "training": "strftime(first - interval 21 day, '%-d-%B-%Y')",
        "training_type": quote(P.TRAINING_TYPE), "rule_visits": "case when enrolled > 0 and visits > 0 then cast(round_even(enrolled * visits * 0.02::double, 0) as bigint) end",
    }
    rows = ", ".join(f"{{'ord': {i}, 'field': {quote(n)}, 'value': nullif(trim(cast({exprs[c]} as varchar)), ''), 'source': {quote(src)}}}" for i, (c, (n, src)) in enumerate(P.TRACKED.items()))
    spoken = ", ".join(f"({quote(k)}, {quote(w)})" for k, words in COUNTRY_LANGUAGES.items() for w in words)
    joins = " ".join(f"left join {part} p{i} using (doc_id)" for i, part in enumerate(parts))
    return f"""with mentions as (select * from {_of("f11_country_mentions", "name", "abbreviation", "pct", "consideration")} c), spoken as (select * from (values {spoken}) v(abbreviation, language)),
    first_country as (select doc_id, country, {" or ".join(f"regexp_matches(text, {quote(p)})" for p in FIRST_VISIT)} as matched from {_of("f28_initial_country", "country")} c join (select doc_id, {repaired_('text')} as text from country_text) d using (doc_id)),
    rows_ as (select doc_id, unnest([{rows}]) as r from (select doc_id from fact_sheet) b {joins})
    select doc_id, r.ord as ord, r.field as field, r.value as value, r.source as source, case when r.value is null then 'review' when r.source like 'computed%' then 'computed' else 'filled' end as status from rows_"""


@check("m1_document_findings", _findings_sql(), "fact_sheet", "country_text")
def _(t):
    return _findings(t)


@check("m2_document_coverage", f"with f as ({_findings_sql()}) select field, status, count(*) as n from f group by rollup (field, status)", "fact_sheet", "country_text")
def _(t):
    return H.corpus_coverage(_findings(t))


@check("l3_stream_documents", _findings_sql(tables=False), "fact_sheet", "country_text")
def _(t):
    """The whole document run on documents as they land, each with its design text and timeline."""
    folder = _folder(t)
    design, timeline = (df.withColumnRenamed("text", c) for df, c in ((t.country_text, "design"), (t.milestone_text, "timeline")))
    t.fact_sheet.join(design, "doc_id").join(timeline, "doc_id").repartition(2).write.parquet(f"{folder}/in")
    landed = t.spark.read.parquet(f"{folder}/in").schema

    def job(batch):
        part = lambda c: batch.select("doc_id", F.col(c).alias("text"))
        return P.document_findings(part("text"), explode_lines(part("text")), part("design"), part("timeline"))

    J.stream_documents(J.arriving(t.spark, f"{folder}/in", landed, 1), job, f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch_id")
