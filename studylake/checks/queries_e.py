"""Study extract."""

from pyspark.sql import functions as F

from studylake.checks.registry import check
from studylake.operators import studies as E
from studylake.sources.readers import select_study_tables

_PHASE = """case lower(trim(case when regexp_matches(phase_raw, '(?i)phase\\s*([ivx1-4]+)') then regexp_extract(phase_raw, '(?i)phase\\s*([ivx1-4]+)', 1) else phase_raw end))
 when 'i' then 'I' when 'ii' then 'II' when 'iii' then 'III' when 'iv' then 'IV' when '1' then 'I' when '2' then 'II' when '3' then 'III' when '4' then 'IV' end"""
_YN = "case when lower(trim(pediatric_raw)) in ('y','yes','true','1') then 'Yes' when lower(trim(pediatric_raw)) in ('n','no','false','0') then 'No' end"

_PACK = "pack as (select alias, string_agg(country || '|' || coalesce(abbr, '') || '|' || coalesce(status, ''), ';;' order by country, coalesce(abbr, ''), coalesce(status, '')) as countries from (select distinct * from study_country where alias is not null and country is not null) s group by alias)"
_ENR = "enr as (select alias, max(case when enrollment_type = 'Enrolled' then total end) as enrolled, max(case when enrollment_type = 'Screened' then total end) as screened from enrollment where plan_kind = 'Planned' and total is not null and enrollment_type in ('Enrolled', 'Screened') group by alias)"
_DATES = ", ".join(f"max(case when milestone_type = '{t}' then milestone_date end) as {n}" for n, t in E.MILESTONE_TYPES.items())
_MS = f"ms as (select alias, {_DATES} from milestone where milestone_type is not null and milestone_date is not null group by alias)"
_STUDIES = f"""{_PACK}, {_ENR}, {_MS}, studies as (select s.alias, coalesce({_PHASE}, '') as phase, coalesce(area, '') as area, coalesce({_YN}, '') as pediatric, coalesce(countries, '') as countries, enrolled, screened,
 pa_date, fpv_date, coalesce(lpv_primary, lpv_all) as lpv_date, fpet_date, lpet_date from study s left join pack on s.alias = pack.alias left join enr on s.alias = enr.alias left join ms on s.alias = ms.alias)"""
_ALL = ("study", "study_country", "enrollment", "milestone")
_D = ("pa_date", "fpv_date", "lpv_date", "fpet_date", "lpet_date")


def tables(t):
    return select_study_tables(t.study, t.study_country, t.enrollment, t.milestone)


def studies(t):
    return E.assemble_studies(tables(t))


def _text_dates(df, names=_D):
    return df.select(*[F.col(c).cast("string").alias(c) if c in names else F.col(c) for c in df.columns])


def _sql_dates(names=_D):
    return ", ".join(f"cast({n} as varchar) as {n}" for n in names)


@check("e1_normalize_phase", f"select alias, {_PHASE} as phase from study", "study")
def _(t):
    return t.study.select("alias", E.normalize_phase(F.col("phase_raw")).alias("phase"))


@check("e2_yes_no", f"select alias, {_YN} as pediatric from study", "study")
def _(t):
    return t.study.select("alias", E.yes_no(F.col("pediatric_raw")).alias("pediatric"))


@check("e3_pack_countries", f"with {_PACK} select * from pack", "study_country")
def _(t):
    return E.pack_countries(t.study_country)


@check("e4_pivot_enrollment", f"with {_ENR} select * from enr", "enrollment")
def _(t):
    return E.pivot_enrollment(tables(t)["enrollment"])


@check("e5_pivot_milestones", f"with {_MS} select alias, {_sql_dates(tuple(E.MILESTONE_TYPES))} from ms", "milestone")
def _(t):
    return _text_dates(E.pivot_milestones(tables(t)["milestone"]), tuple(E.MILESTONE_TYPES))


@check("e6_coalesce_milestone", f"with {_MS} select alias, cast(coalesce(lpv_primary, lpv_all) as varchar) as lpv_date from ms", "milestone")
def _(t):
    return _text_dates(E.coalesce_milestone(E.pivot_milestones(tables(t)["milestone"]))).select("alias", "lpv_date")


@check("e7_assemble_studies", f"with {_STUDIES} select alias, phase, area, pediatric, countries, enrolled, screened, {_sql_dates()} from studies", *_ALL)
def _(t):
    return _text_dates(studies(t))


def _stored(t):
    """Keys seen before: studies that had planned enrollment."""
    return tables(t)["enrollment"].select("alias").distinct()


@check("e8_incremental_new_rows", f"with {_STUDIES} select alias, phase, countries from studies where alias not in (select alias from enrollment where plan_kind = 'Planned')", *_ALL)
def _(t):
    return E.new_rows(studies(t), _stored(t), "alias").select("alias", "phase", "countries")


@check(
    "e9_run_summary",
    """with old as (select distinct alias from enrollment where plan_kind = 'Planned')
    select count(*) filter (where alias not in (select alias from old)) as added, count(*) as total_in_source, count(*) filter (where alias not in (select alias from old)) + (select count(*) from old) as total_in_file from study""",
    "study", "enrollment",
)
def _(t):
    return E.run_summary(t.study, _stored(t))


@check(
    "e10_lookup_fields",
    f"""with {_STUDIES}, req as (select distinct alias from milestone)
    select r.alias, case when s.alias is null then 'not_found' else 'ok' end as status, case when s.alias is not null then array_to_string(list_filter(['Countries in scope=' || nullif(countries, ''), 'Patients enrolled (randomized)=' || enrolled, 'Patients screened=' || screened, 'Pediatric population?=' || nullif(pediatric, ''), 'Phase=' || nullif(phase, ''),
      'Planned First Patient Visit (FPV) date=' || fpv_date, 'Planned Last Patient Visit (LPV) date=' || lpv_date, 'Protocol Approval (PA) date=' || pa_date, 'Therapeutic Area=' || nullif(area, '')], lambda x: x is not null), chr(10)) end as fields, coalesce(pa_date, fpv_date, lpv_date, fpet_date, lpet_date) is not null as has_milestones
    from req r left join studies s on r.alias = s.alias""",
    *_ALL,
)
def _(t):
    found = E.lookup_fields(t.milestone, studies(t))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("alias", "status", F.array_join(pairs, "\n").alias("fields"), F.col("milestones").isNotNull().alias("has_milestones"))


@check("e11_unpack_countries", "select distinct alias, country as name, abbr as abbreviation, status from study_country where country <> ''", "study_country")
def _(t):
    return E.unpack_countries(E.pack_countries(t.study_country))


@check(
    "e12_fill_from_extract",
    f"""with {_STUDIES}, docs as (select o_orderkey as doc_id, 'ST' || o_custkey as alias, o_orderpriority as value, o_orderkey % 3 as m from orders),
    txt as (select doc_id, alias, case when m = 0 then 'Phase' else 'Title' end as field, value from docs),
    st as (select alias, unnest(['Countries in scope', 'Patients enrolled (randomized)', 'Patients screened', 'Pediatric population?', 'Phase', 'Planned First Patient Visit (FPV) date', 'Planned Last Patient Visit (LPV) date', 'Protocol Approval (PA) date', 'Therapeutic Area']) as field,
      unnest([countries, cast(enrolled as varchar), cast(screened as varchar), pediatric, phase, cast(fpv_date as varchar), cast(lpv_date as varchar), cast(pa_date as varchar), area]) as stored from studies),
    j as (select d.doc_id, d.alias, s.field, s.stored from docs d join st s on d.alias = s.alias where stored <> '')
    select coalesce(t.doc_id, j.doc_id) as doc_id, coalesce(t.alias, j.alias) as alias, coalesce(t.field, j.field) as field, coalesce(stored, value) as value, case when stored is not null then 'extract' else 'text' end as source
    from txt t full join j on t.doc_id = j.doc_id and t.field = j.field""",
    *_ALL,
)
def _(t):
    text = t.orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("ST"), "o_custkey").alias("alias"),
        F.when(F.col("o_orderkey") % 3 == 0, "Phase").otherwise("Title").alias("field"),
        F.col("o_orderpriority").alias("value"),
    )
    return E.fill_from_extract(text, E.lookup_fields(text, studies(t)))
