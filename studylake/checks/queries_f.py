"""Field extraction."""

import re

from pyspark.sql import functions as F

from studylake.checks import registry
from studylake.checks.queries_c import _SECT
from studylake.checks.sqltext import extract_, match_, quote, repaired_, squeeze_, strip_, tiers_
from studylake.functions import dates as DT
from studylake.functions import fixed as X
from studylake.functions.rules import Rule, first_tier, hit_rates, rule_hits
from studylake.functions.text import repaired
from studylake.operators import countries as C
from studylake.operators import fields as R
from studylake.operators import structure as S



def check(name: str, sql: str | None = None, *tables: str):
    """As in the registry; texts are repaired before their fields are read."""
    for table in ("fact_sheet", "country_text", "milestone_text"):
        if sql and table in tables:
            source = f"from (select * replace ({repaired_('text')} as text) from {table})"
            sql = re.sub(rf"\bfrom {table}\b( [a-z]\b)?", lambda m, source=source, table=table: source + (m[1] or f" {table}"), sql)
    return registry.check(name, sql, *tables)


# The SQL has no look-ahead; no text has a digit where the rules forbid one.
_NUMBER = [Rule(r.pattern.replace(r"(?!\d)", "")) for r in R.PROTOCOL_NUMBER]


def _num(x: str, patterns, low=None, high=None) -> str:
    parts = []
    for p in patterns:
        n = f"try_cast(replace({extract_(x, p)}, ',', '') as int)"
        parts.append(f"case when {match_(x, p)} {f'and {n} between {low} and {high}' if low is not None else ''} then {n} end")
    return "coalesce(" + ", ".join(parts) + ")"


def _col(t, fn, name):
    return repaired(t.fact_sheet).select("doc_id", fn(F.col("text")).alias(name))


@check(
    "f1_rule_hits",
    "with h as (" + " union all ".join(
        f"select doc_id, {quote(f)} as field, {i} as tier, {strip_(extract_('text', r.pattern, r.group))} as value from fact_sheet where {match_('text', r.pattern)}"
        for f, rules in (("protocol_number", _NUMBER), ("phase", R.PHASE)) for i, r in enumerate(rules, 1)
    ) + ") select doc_id, field, min(tier) as tier, min_by(value, tier) as value from h group by doc_id, field",
    "fact_sheet",
)
def _(t):
    return first_tier(rule_hits(repaired(t.fact_sheet), "doc_id", "text", {"protocol_number": R.PROTOCOL_NUMBER, "phase": R.PHASE}), "doc_id")


@check(
    "f1_hit_rates",
    "with h as (" + " union all ".join(
        f"select {quote(f)} as field, {i} as tier from fact_sheet where {match_('text', r.pattern)}"
        for f, rules in (("protocol_number", _NUMBER), ("phase", R.PHASE)) for i, r in enumerate(rules, 1)
    ) + ") select field, tier, count(*) as hits from h group by field, tier",
    "fact_sheet",
)
def _(t):
    return hit_rates(rule_hits(repaired(t.fact_sheet), "doc_id", "text", {"protocol_number": R.PROTOCOL_NUMBER, "phase": R.PHASE}))


@check("f2_protocol_number", f"select doc_id, {tiers_('text', _NUMBER)} as protocol_number from fact_sheet", "fact_sheet")
def _(t):
    return _col(t, R.protocol_number, "protocol_number")


_COMPOUND = rf"""select doc_id, coalesce(nullif(trim(regexp_extract(text, '(?i)Compound\s*:\s*([A-Za-z][A-Za-z0-9\s\-]+?)\s*\(\s*(?:[A-Z0-9]+)\s*\)', 1)), ''),
 nullif(regexp_extract(text, '(?i)Compound\s*:\s*([A-Z]{{2}} ?\d{{6,8}})\b', 1), ''),
 nullif(trim(regexp_replace({squeeze_("regexp_extract(text, 'Compound" + chr(92) + "s*:" + chr(92) + "s*([^;" + chr(92) + "n]{2,60})', 1)")}, '\s*\(.*', '')), ''),
 nullif({squeeze_("regexp_extract(text, 'Investigational" + chr(92) + "s+(?:Product|Agent|Drug)(?:" + chr(92) + "(s" + chr(92) + "))?:" + chr(92) + "s*([^;" + chr(92) + "n]+)', 1)")}, ''),
 nullif(regexp_extract(text, '\b[A-Z]{{2}} ?\d{{6,8}}', 0), ''),
 case when regexp_extract(text, '(?:Effect|Study|Trial|Comparison|Safety|Efficacy|Bioequivalence)(?:\s+of\s+)([A-Z][a-z]{{4,}}(?:\s*[A-Z][a-z]{{2,}})?)', 1) not in ('', 'Patients') then regexp_extract(text, '(?:Effect|Study|Trial|Comparison|Safety|Efficacy|Bioequivalence)(?:\s+of\s+)([A-Z][a-z]{{4,}}(?:\s*[A-Z][a-z]{{2,}})?)', 1) end) as compound from fact_sheet"""


@check("f3_compound", _COMPOUND, "fact_sheet")
def _(t):
    return _col(t, R.compound, "compound")


@check(
    "f4_title",
    "select o_orderkey as doc_id, case o_orderkey % 3 when 0 then 'A Phase ' || (o_orderkey % 4) || ' study of item ' || o_custkey || ' in adults with gout' when 1 then 'LONG TERM SAFETY OF ITEM ' || o_custkey || ' IN ADULTS WITH GOUT' end as title from orders",
)
def _(t):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("Protocol AB-1\n A Phase "), k % 4, F.lit("  study of item "), F.col("o_custkey"), F.lit(" in adults with\ngout Protocol Number: X")))
        .when(k % 3 == 1, F.concat(F.lit("Intro\n L O N G TERM SAFETY OF ITEM "), F.col("o_custkey"), F.lit(" IN ADULTS WITH GOUT Sponsor")))
        .otherwise(F.lit("Protocol Title: short Protocol Number: 1"))
    )
    return repaired(t.orders.select(k.alias("doc_id"), text.alias("text"))).select("doc_id", R.title(F.col("text")).alias("title"))


@check("f5_phase", f"select doc_id, trim(rtrim({tiers_('text', R.PHASE)}, ',')) as phase from fact_sheet", "fact_sheet")
def _(t):
    return _col(t, R.phase, "phase")


@check(
    "f6_area_by_label",
    f"""with s as (select doc_id, {tiers_('text', R.AREA_LABEL)} as l, {tiers_('text', R.CONDITION_LABEL)} as c from fact_sheet), v as (select doc_id, l, rtrim(trim(regexp_replace(l, '\\s*\\([^)]*\\)', '', 'g')), '.') as a, trim(trim(c, '.')) as c from s)
    select doc_id, case when l is not null then case when length(a) > 3 then a end when length(c) > 3 then c end as area from v""",
    "fact_sheet",
)
def _(t):
    return _col(t, R.area_by_label, "area")


_AREA = "case " + " ".join(f"when contains(lower(text), {quote(w)}) then {quote(a)}" for w, a in X.AREA_KEYWORDS) + " end"


@check("f7_area_by_keyword", f"select doc_id, {_AREA} as area from (select doc_id, text from documents union all select doc_id + 1000000, text from fact_sheet) d", "fact_sheet")
def _(t):
    docs = t.documents.select("doc_id", "text").union(repaired(t.fact_sheet).select(F.col("doc_id") + 1000000, "text"))
    return docs.select("doc_id", R.area_by_keyword(F.col("text")).alias("area"))


@check(
    "f7_area_hits",
    "with k as (" + " union all ".join(f"select {i} as ord, {quote(w)} as keyword, {quote(a)} as area" for i, (w, a) in enumerate(X.AREA_KEYWORDS)) + ") select doc_id, ord, keyword, area from fact_sheet join k on contains(lower(text), keyword)",
    "fact_sheet",
)
def _(t):
    return R.area_hits(repaired(t.fact_sheet))


@check(
    "f8_indication",
    r"""select doc_id, nullif(rtrim(trim(regexp_replace(coalesce(nullif(regexp_extract(text, 'Indication:\s*(.+?)(?:\n|$)', 1), ''), nullif(regexp_extract(text, 'Indication\s*[\(\)]*\s*:\s*(.+?)(?:\n|$)', 1), ''),
      rtrim(nullif(trim(regexp_extract(regexp_extract(text, 'Protocol\s+Title\s*:\s*(.+?)(?:\n|$)', 1), '\bin\s+(.+?)\s*$', 1)), ''), '.')), '\s+', ' ', 'g')), '.'), '') as indication from fact_sheet""",
    "fact_sheet",
)
def _(t):
    return _col(t, R.indication, "indication")


@check("f9_enrollment_first", f"select doc_id, {_num('text', ['(?i)' + p for p in R.ENROLLMENT], 2, 100000)} as enrolled from fact_sheet", "fact_sheet")
def _(t):
    return _col(t, R.enrollment_first, "enrolled")


def _line_numbers(pattern: str, group: int) -> str:
    """Numbers of the lines by a pattern; what it must not touch is matched instead, on text whose other characters stand twice."""
    plain = re.sub(r"\(\?<?!(\[[^\]]*\])\)", lambda m: f"(?:^|$|[^{m[1][1:]})", pattern)
    line = "s" if plain == pattern else "regexp_replace(s, '([^A-Za-z0-9–-])', '\\1\\1', 'g')"
    found = f"flatten(list_transform(lines, lambda s: regexp_extract_all({line}, {quote(plain)}, {group})))"
    return f"list_filter(list_transform({found}, lambda n: try_cast(n as int)), lambda n: n between 10 and 100000 and n not between 1900 and 2100)"


@check(
    "f10_enrollment_highest",
    f"with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, {quote(R.ENROLLMENT_LINE)})) as lines from fact_sheet) select doc_id, coalesce(list_max(flatten(["
    + ", ".join(_line_numbers(p, g) for p, groups in R.ENROLLMENT_STRONG for g in groups) + f"])), list_max({_line_numbers(R.ENROLLMENT_WEAK, 1)})) as enrolled from l",
    "fact_sheet",
)
def _(t):
    return _col(t, R.enrollment_highest, "enrolled")


# --- countries -------------------------------------------------------------------------------

_ALIASES = "[" + ", ".join(
    f"{{'k': {quote(k)}, 'p': {quote(('' if len(a) <= 3 and a.upper() == a else '(?i)') + chr(92) + 'b' + re.escape(a).replace(chr(92) + ' ', ' ') + chr(92) + 'b')}, 'e': {quote(chr(92) + 'b' + re.escape(a).replace(chr(92) + ' ', ' ') + chr(92) + 'b')}, 'a': {quote(a)}}}"
    for a, k in C._LONGEST
) + "]"
_INFO = "info as (select * from (values " + ", ".join(f"({quote(k)}, {quote(n)}, {quote(s)})" for k, (n, s) in X.COUNTRIES.items()) + ") v(key, name, abbreviation))"
_AL = f"al as (select unnest({_ALIASES}) as x), als as (select x.k as k, x.p as p, x.e as e, x.a as a from al)"


def _frag(pattern: str, group: int = 0, source: str = "text") -> str:
    return extract_(source, pattern, group)


_PLAN = f"case when regexp_matches(text, {quote(C._PLAN)}) then substring(text, instr(text, regexp_extract(text, {quote(C._PLAN)}, 0))) else '' end"
_F11 = rf"""{_AL}, {_INFO}, d as (select doc_id, text, {_PLAN} as chunk from country_text),
seg as (select doc_id, unnest(regexp_extract_all(chunk, '(?i)([^\n]*?target\s*(\d+)%)', 1)) as line, unnest(regexp_extract_all(chunk, '(?i)([^\n]*?target\s*(\d+)%)', 2)) as n from d),
fr as (select doc_id, {_frag(C._IN_SCOPE)} as f, 1 as step, null::double as pct, false as cons from d union all select doc_id, {_frag('(?i)consideration can be given to ([^.;]+)', 1)}, 2, null, true from d
 union all select doc_id, line, 3, cast(n as double) / 100, false from seg union all select doc_id, chunk, 4, null, false from d union all select doc_id, {_frag(C._UNITS, 0, 'chunk')}, 5, null, true from d),
h as (select distinct doc_id, k as key, step, pct, cons from fr join als on regexp_matches(f, e)),
a as (select * from h union all select distinct d.doc_id, k, 6, null, false from d join als on regexp_matches(text, e) where d.doc_id not in (select doc_id from h))
select doc_id, name, abbreviation, min_by(pct, step) filter (where pct is not null) as pct, bool_or(cons) as consideration from a join info on a.key = info.key group by all"""


@check("f11_country_mentions", f"with {_F11}", "country_text")
def _(t):
    return C.country_mentions(repaired(t.country_text))


_F13 = rf"""d as (select doc_id, text, {_PLAN} as chunk from SRC),
p1 as (select doc_id, unnest(regexp_extract_all(text, '(?i)(\w+(?:\s+\w+)?)\s+at\s+target\s+(\d+)%', 1)) as nm, unnest(regexp_extract_all(text, '(?i)(\w+(?:\s+\w+)?)\s+at\s+target\s+(\d+)%', 2)) as n from d),
p5 as (select doc_id, unnest(regexp_extract_all(text, '(?i)(\d+)\s*(?:sites?|patients?|subjects?)\s*(?:in|for)\s+(\w+(?:\s+\w+)?)', 2)) as nm, unnest(regexp_extract_all(text, '(?i)(\d+)\s*(?:sites?|patients?|subjects?)\s*(?:in|for)\s+(\w+(?:\s+\w+)?)', 1)) as n from d),
f as (select doc_id, {_frag(C._IN_SCOPE)} as f, false as cons from d union all select doc_id, {_frag(C._UNITS)}, true from d union all select doc_id, chunk, false from d),
h1 as (select doc_id, k as key, cast(n as double) / 100 as pct, false as cons, null::int as sites from p1 join als on lower(a) = lower(rtrim(trim(nm), '.'))
 union all select doc_id, k, null, cons, null from f join als on regexp_matches(f, e) union all select doc_id, k, null, false, cast(n as int) from p5 join als on lower(a) = lower(rtrim(trim(nm), '.'))),
s6 as (select doc_id, unnest(list_concat(regexp_extract_all(text, '\b([A-Za-z][\w\s]{{0,25}}?)-only\b', 1), regexp_extract_all(text, '(?i)(?:will be|is)\s+(?:sited\s+)?(?:all\s+)?(?:only\s+)?in\s+(?:the\s+)?([A-Za-z][\w\s]{{0,25}}?)(?:[\.,;]|\s+and\b|$)', 1))) as nm from d where doc_id not in (select doc_id from h1)),
h6 as (select doc_id, k as key, null::double as pct, false as cons, null::int as sites from s6 join als on lower(a) = lower(rtrim(trim(nm), '.'))),
s7 as (select doc_id, unnest(regexp_split_to_array(text, '[.!?]\s+')) as s from d where doc_id not in (select doc_id from h1) and doc_id not in (select doc_id from h6)),
h7 as (select doc_id, k as key, null::double as pct, false as cons, null::int as sites from s7 join als on regexp_matches(s, e) where regexp_matches(s, '(?i)\b(?:enroll\w*|conduct\w*|sit(?:e|ed|ing)\w*|study\s+will|trial\s+will|take\s+place)')),
sect as (select doc_id, name, abbreviation, max(pct) as pct, bool_or(cons) as consideration, max(sites) as sites from (select * from h1 union all select * from h6 union all select * from h7) u join info on u.key = info.key group by all)"""


@check("f13_country_section", f"with {_AL}, {_INFO}, {_F13.replace('SRC', 'country_text')} select * from sect", "country_text")
def _(t):
    return C.country_section(repaired(t.country_text))


_F12 = rf"""with {_AL}, {_INFO}, ln as (select doc_id, unnest(string_split(text, chr(10))) as line from country_text),
v as (select doc_id, case when regexp_matches(line, '(?i)country\s*check') then case when line like '|%' then trim(string_split(line, '|')[5]) else regexp_replace(line, '(?i)^.*?country\s*check', '') end else line end as value, regexp_matches(line, '(?i)country\s*check') as row_ from ln
 where regexp_matches(line, '(?i)country\s*check|in scope for (the )?country allocation')),
st as (select doc_id, value, case when not row_ or (regexp_matches(value, '(?i)will be in scope|countries in scope include|in scope for country allocation|\bin scope\b') and not regexp_matches(value, '(?i)consideration|not required|utilized')) then 'confirmed' else 'under_consideration' end as status from v),
hs as (select doc_id, k as key, min(status) as status from st join als on regexp_matches(value, p) group by all),
rest as (select doc_id, text from country_text where doc_id not in (select doc_id from hs)), {_F13.replace('SRC', 'rest')}
select doc_id, name, abbreviation, null::double as pct, status from hs join info on hs.key = info.key union all select doc_id, name, abbreviation, pct, case when consideration then 'under_consideration' else 'confirmed' end from sect"""


@check("f12_country_check_row", _F12, "country_text")
def _(t):
    return C.country_check_row(repaired(t.country_text))


@check(
    "f28_initial_country",
    f"""with {_AL}, {_INFO}, p as (""" + " union all ".join(f"select doc_id, {i} as tier, unnest(regexp_extract_all(text, {quote(p)}, 1)) as f from country_text" for i, p in enumerate(C.FIRST_VISIT)) + """),
    o as (select doc_id, tier, k, row_number() over (partition by doc_id order by tier, length(a) desc) as r from p join als on regexp_matches(f, p.p) qualify r = 1)
    select c.doc_id, coalesce(name, 'US') as country from country_text c left join o on c.doc_id = o.doc_id left join info on o.k = info.key""".replace("p.p)", "als.p)"),
    "country_text",
)
def _(t):
    return repaired(t.country_text).select("doc_id", F.coalesce(C.initial_country(F.col("text")), F.lit("US")).alias("country"))


@check(
    "f34_parse_country_input",
    r"""with u as (select doc_id, trim(unnest(string_split(raw, ','))) as part from country_list)
    select doc_id, trim(regexp_replace(part, '\s*\(.*\)\s*', '')) as name, try_cast(nullif(regexp_extract(part, '\((\d+(?:\.\d+)?)\s*%\)', 1), '') as double) / 100 as pct, contains(lower(part), 'consideration') as consideration from u where trim(regexp_replace(part, '\s*\(.*\)\s*', '')) <> ''""",
    "country_list",
)
def _(t):
    return t.country_list.select("doc_id", F.inline(C.parse_country_input(F.col("raw")))).drop("abbreviation")


# --- milestones, languages, dates -----------------------------------------------------------------


def _milestones_sql() -> str:
    arms = []
    for key in X.MILESTONES:
        v = r"\s*([^\n•]+)"
        strict = f"nullif(trim({extract_('chunk', key + ':' + v)}), '')"
        labels = [key, *X.MILESTONE_SYNONYMS.get(key, [])]
        loose = "case " + " ".join(f"when {match_('text', '(?i)' + n + chr(92) + 's*:' + v)} then nullif(trim({extract_('text', '(?i)' + n + chr(92) + 's*:' + v)}), '')" for n in labels) + " end"
        gloss = f"regexp_extract_all(regexp_extract(text, {quote('(?is)(.{0,120}?)' + chr(92) + '(' + chr(92) + 's*' + key + chr(92) + 's*' + chr(92) + ')')}, 1), {quote(X.WRITTEN_DATE)})[-1]"
        arms.append(f"select doc_id, {quote(key)} as milestone, coalesce({strict}, {loose}, trim({gloss})) as value from d")
    return "with s as (select doc_id, text, case when instr(lower(text), 'document key milestone estimates') > 0 then instr(lower(text), 'document key milestone estimates') else instr(lower(text), 'timeline') end as b from milestone_text), d as (select doc_id, text, case when b > 0 then substring(text, b, 2000) end as chunk from s), a as (" + " union all ".join(arms) + ") select * from a where value is not null"


@check("f14_milestones_text", _milestones_sql(), "milestone_text")
def _(t):
    return repaired(t.milestone_text).select("doc_id", F.explode(R.milestones_text(F.col("text"))).alias("milestone", "value"))


@check(
    "f15_milestones_section",
    """select o_orderkey as doc_id, 'Protocol Approval' as milestone, (o_orderkey % 28 + 1) || '-Jan-2026' as value from orders union all select o_orderkey, 'FPV', (o_orderkey % 28 + 1) || '-March-2026' from orders where o_orderkey % 5 <> 0
    union all select o_orderkey, 'LPV', 'December-' || (2027 + o_orderkey % 3) from orders""",
)
def _(t):
    sections = S.parse_sections(t.design_line).where("number = '45'")
    return sections.select("doc_id", F.explode(R.milestones_section(F.col("text"))).alias("milestone", "value"))


@check(
    "f16_milestones_qa",
    "select o_orderkey as doc_id, unnest(['protocol_approval', 'fpv']) as field, unnest(['15-Jan-2026', 'March 2026']) as value from qa where s = 'Timeline'",
    "qa",
)
def _(t):
    rows = t.qa.where("s = 'Timeline'")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.explode(R.milestones_qa(F.col("d"))).alias("field", "value"))


@check("f17_min_age", f"select doc_id, {_num('text', ['(?i)' + p for p in R.MIN_AGE])} as min_age from fact_sheet", "fact_sheet")
def _(t):
    return _col(t, R.min_age, "min_age")


_DOCS = "(select doc_id, text from documents union all select doc_id + 1000000, text from fact_sheet) d"


@check("f18_is_oncology", f"select doc_id, regexp_matches(lower(text), {quote('|'.join(X.ONCOLOGY))}) as is_oncology from {_DOCS}", "fact_sheet")
def _(t):
    docs = t.documents.select("doc_id", "text").union(repaired(t.fact_sheet).select(F.col("doc_id") + 1000000, "text"))
    return docs.select("doc_id", R.is_oncology(F.col("text")).alias("is_oncology"))


@check("f19_has_checkpoint_inhibitor", f"select doc_id, regexp_matches(text, {quote('(?i)' + '|'.join(X.CHECKPOINT_INHIBITORS))}) as has_inhibitor from {_DOCS}", "fact_sheet")
def _(t):
    docs = t.documents.select("doc_id", "text").union(repaired(t.fact_sheet).select(F.col("doc_id") + 1000000, "text"))
    return docs.select("doc_id", R.has_checkpoint_inhibitor(F.col("text")).alias("has_inhibitor"))


@check("f20_immunogenicity", f"with v as (select doc_id, lower({tiers_('text', [Rule(p) for p in R.IMMUNOGENICITY])}) as v from fact_sheet) select doc_id, case when v = 'no' then 'No' when v is not null then 'Yes' end as immunogenicity from v", "fact_sheet")
def _(t):
    return _col(t, R.immunogenicity, "immunogenicity")


@check(
    "f21_genetics",
    "with v as (select doc_id, text, coalesce(" + ", ".join(f"case when lower({extract_('text', p, g)}) in ('yes', 'no') then {extract_('text', p, g)} end" for p, g in R.GENETICS)
    + ") as v from fact_sheet) select doc_id, case when v is not null then upper(v[1]) || lower(v[2:]) when regexp_matches(text, '(?i)genetics|pgx|pharmacogenom') then case when regexp_matches(text, '(?i)no\\s+(genetics|pgx)') then 'No' else 'Yes' end end as genetics from v",
    "fact_sheet",
)
def _(t):
    return _col(t, R.genetics, "genetics")


@check(
    "f22_screen_fail_rate",
    f"select doc_id, coalesce({_num('text', [R.SCREEN_FAIL_LENIENT])} / 100, 0.3::double) as rate, {_num('text', [R.SCREEN_FAIL_STRICT], 0, 95)} / 100 as strict_rate from fact_sheet",
    "fact_sheet",
)
def _(t):
    return repaired(t.fact_sheet).select("doc_id", R.screen_fail_rate(F.col("text")).alias("rate"), R.screen_fail_rate_strict(F.col("text")).alias("strict_rate"))


@check(
    "f23_design_flags",
    """select o_orderkey as doc_id, cast(null as boolean) as is_immuno_oncology, case when o_orderkey % 3 = 0 then true else false end as immunogenicity_needed,
    case when o_orderkey % 2 = 1 and o_orderkey % 3 <> 1 then true end as genetics_collected, case when o_orderkey % 3 = 0 then false end as includes_pediatric,
    case when o_orderkey % 2 = 1 and o_orderkey % 3 = 1 then false end as is_decentralized from orders""",
)
def _(t):
    return R.design_flags(S.parse_sections(t.design_line).where("level = 1"))


@check(
    "f24_enrollment_section",
    """select o_orderkey as doc_id, case o_orderkey % 4 when 0 then o_custkey + 100 when 1 then o_custkey + 10 when 2 then case when o_custkey + 100 between 100 and 9999 then o_custkey + 100 else cast(right(cast(o_custkey + 100 as varchar), 4) as int) end end as planned,
    case when o_orderkey % 3 < 2 and o_orderkey % 50 > 0 then (o_orderkey % 50) / 100 else 0.3::double end as screen_fail_rate, case when o_orderkey % 7 < 4 then (o_orderkey % 20 + 1) / 100 else 0.1::double end as early_discontinuation_rate from orders""",
)
def _(t):
    sections = S.parse_sections(t.design_line).where("number = '39'")
    return sections.select("doc_id", R.enrollment_section(F.col("text")).alias("e")).select("doc_id", "e.*")


_RANK = "case " + " ".join(f"when contains(lower(x), {quote(w)}) then {i}" for i, (w, _) in enumerate(X.AREA_KEYWORDS)) + " end"
_NAMES = "(select string_agg(distinct k, '; ' order by k) from als where regexp_matches(r.d, e))"
_YES = "case when low like 'yes%' or contains(low, {0}) then true when low like 'no%' {1} then false end"
_QA = f"""{_AL}, r as (select o_orderkey as doc_id, l_linenumber as n, lower(trim(s)) as sec, lower(e) as el, d, lower(d) as low, concat_ws(' ', d, e) as x from qa),
v as (select *, coalesce({_num('d', ['N\\s*=\\s*(\\d+)'])}, {_num('d', ['(?i)(?:Approximately|About|Total of)\\s+(\\d+)'])}) as planned,
 {_num('d', ['(?i)discontinuation\\s+rate\\s+(?:of\\s+)?(?:approximately\\s+)?(\\d+)\\s*%'])} / 100 as gone, {_num('d', ['(?i)screen\\s*fail(?:ure)?\\s*(?:rate)?\\s*[:=]?\\s*(\\d+)\\s*%'])} / 100 as failed,
 {_num('d', ['(?i)' + p for p in R.MIN_AGE])} as age, case sec when 'peds' then 0 when 'population' then 1 when 'inclusion' then 2 when 'eligibility' then 3 end as place,
 case when regexp_matches(low, 'n/a|only participants over 18|adults only') then false when regexp_matches(low, 'yes|adolescent|pediatric') then true end as by_word,
 {_YES.format("'will be collected'", "")} as immuno, {_YES.format("'collect'", "or low like 'n/a%'")} as genetic, nullif(regexp_extract(d, '(?i)Phase\\s+(\\d+[a-z]?)', 1), '') as phase, {_RANK} as kw, {_AREA.replace('text', 'x')} as area,
 case when sec in ('country check', 'overview') then {_NAMES} end as names from r)
select doc_id, min_by(planned, n) filter (sec in ('stats', 'objectives / stats') and planned is not null) as planned,
 coalesce(max_by(failed, n) filter (sec in ('stats', 'objectives / stats') and failed is not null), 0.3::double) as screen_fail_rate, coalesce(max_by(gone, n) filter (sec in ('stats', 'objectives / stats') and gone is not null), 0.1::double) as early_discontinuation_rate,
 min_by('protocol_approval=' || regexp_extract(d, 'Protocol Approval: (\\S+)', 1) || '; fpv=' || regexp_extract(d, 'First Patient Visit: (\\w+ \\d+)', 1), n) filter (sec = 'timeline') as milestones,
 max_by(immuno, n) filter (sec = 'design' and contains(el, 'immunogenicity') and immuno is not null) as immunogenicity_needed, max_by(genetic, n) filter (sec = 'design' and regexp_matches(el, 'genetics|pgx') and genetic is not null) as genetics_collected,
 coalesce((min_by(age, place * 100 + n) filter (age is not null and place is not null)) < 18, max_by(by_word, n) filter (sec = 'peds' and by_word is not null)) as includes_pediatric,
 max_by(phase, n) filter (sec = 'title' and contains(el, 'phase') and phase is not null) as phase, min_by(area, kw * 100 + n) filter (sec in ('title', 'overview') and kw is not null) as area,
 coalesce(max_by(names, n) filter (sec = 'country check' and names is not null), max_by(names, n) filter (sec = 'overview' and regexp_matches(el, 'regulatory|country') and names is not null), '') as countries from v group by doc_id"""


@check("f25_qa_fields", f"with {_QA}", "qa")
def _(t):
    from studylake.plans.design import qa_fields

    return qa_fields(S.question_rows(t.question_line))


def _spellings() -> str:
    word = lambda n: re.escape(n).replace(chr(92) + " ", " ")
    rows = [(k, i, n, rf"\b{word(n)}\b", rf"{word(n)}[^.]*?(\d+)\s*%", rf"(?is)(.{{0,20}}{word(n)}.{{0,50}})") for k, names in X.ALIASES.items() for i, n in enumerate(names)]
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else quote(x) for x in row) + ")" for row in rows)


@check(
    "f25_qa_countries",
    f"""with sp as (select * from (values {_spellings()}) v(k, i, a, whole, share, near)), h as (select o_orderkey as doc_id, k, i,
     {{'pct': try_cast(nullif(regexp_extract(d, share, 1), '') as int) / 100, 'maybe': regexp_matches(lower(regexp_extract(d, near, 1)), 'consideration|low probability')}} as c
     from qa join sp on contains(d, a) and regexp_matches(d, whole) where lower(trim(s)) = 'country check')
    select doc_id, k as key, min_by(c, i).pct as pct, min_by(c, i).maybe as consideration from h group by doc_id, k""",
    "qa",
)
def _(t):
    from studylake.plans.design import qa_countries

    return qa_countries(S.question_rows(t.question_line))


def _record_sql() -> str:
    part = lambda name: f"(select * from ({registry.REGISTRY[name].sql}) q)"
    area = "coalesce(" + ", ".join(f"case when length({v}) > 3 then {v} end" for v in (f"rtrim({strip_(extract_('text', r.pattern, r.group))}, '.')" for r in R.AREA_DESIGN)) + ")"
    return f"""with {_SECT}, {_AL}, {_INFO}, src as (select doc_id, text from full_sec where number = '38'), {_F13.replace('SRC', 'src')},
    co as (select doc_id, string_agg(name, '; ' order by consideration, name) as countries from sect group by doc_id),
    ms as (select doc_id, string_agg(milestone || '=' || value, '; ' order by milestone) as milestones from {part("f15_milestones_section")} m group by doc_id),
    ar as (select doc_id, min_by(area, line_no) as area from (select doc_id, line_no, {area} as area from design_line where regexp_matches(text, '(?i)Therapeutic\\s+Area|TA:')) l where area is not null group by doc_id)
    select d.doc_id, planned, coalesce(screen_fail_rate, 0.3::double) as screen_fail_rate, coalesce(early_discontinuation_rate, 0.1::double) as early_discontinuation_rate, milestones, immunogenicity_needed, genetics_collected, includes_pediatric,
      cast(null as varchar) as phase, area, countries
    from (select distinct doc_id from full_sec) d left join {part("f24_enrollment_section")} e on e.doc_id = d.doc_id left join {part("f23_design_flags")} f on f.doc_id = d.doc_id
    left join co on co.doc_id = d.doc_id left join ms on ms.doc_id = d.doc_id left join ar on ar.doc_id = d.doc_id"""


@check("f26_design_record", _record_sql(), "design_line")
def _(t):
    from studylake.plans.design import design_record

    return design_record(t.design_line)


@check(
    "f27_required_languages",
    f"""with b as (select doc_id, case when regexp_matches(text, '(?i)(?:Translations|Language)[^.]*(?:list|required|needed)[^.]*') then text when regexp_matches(text, '(?i)(?:translations will be provided in|translate into|languages?:)\\s*') then regexp_extract(text, '(?i)(?:translations will be provided in|translate into|languages?:)\\s*.*', 0) else '' end as block from language_text)
    select doc_id, unnest(list_filter([{', '.join(quote(w) for w in X.LANGUAGES)}], lambda w: regexp_matches(block, '(?i)\\b' || w || '\\b'))) as language from b""",
    "language_text",
)
def _(t):
    return t.language_text.select("doc_id", F.explode(R.required_languages(F.col("text"))).alias("language"))


_LAB = "select doc_id, line_no, trim(split_part(text, '|', 2)) as analyte, trim(split_part(text, '|', 3)) as comment from protocol_line where line_no between 121 and 179"


def _analytes(t):
    """Rows of the laboratory tables, wherever a document has them."""
    rows = S.pipe_rows(t.protocol_line).where(~F.col("is_header") & F.try_element_at("header", F.lit(1)).rlike(r"(?i)^clinical\s+laboratory\s+tests$"))
    return rows.select("doc_id", "line_no", F.col("cells")[0].alias("analyte"), F.try_element_at("cells", F.lit(2)).alias("comment"))


@check("f29_analytes_by_phrase", f"with l as ({_LAB}) select doc_id, analyte, min(line_no) as line_no from l where regexp_matches(lower(comment), 'not be reported|blinded') group by doc_id, analyte", "protocol_line")
def _(t):
    return R.analytes_by_phrase(_analytes(t), ["not be reported", "Blinded"])


@check(
    "f30_not_reported_groups",
    r"""select doc_id, array_to_string(list_filter([case when regexp_matches(lower(text), '\bpk\b|pharmacokinetic') then 'PK' end, case when regexp_matches(text, '\b[A-Z]{2} ?\d{6,8}\b') then 'compound assay' end,
     case when regexp_matches(lower(text), '\bada\b|anti[- ]drug antibod') then 'ADA' end, case when contains(text, 'needed? Yes') or contains(text, 'assessment will be performed') then 'Immunogenicity' end, case when contains(lower(text), 'biomarker') then 'Biomarkers' end], lambda x: x is not null), ', ') as assays from fact_sheet""",
    "fact_sheet",
)
def _(t):
    groups = R.not_reported_groups(F.col("text"), F.lit(None).cast("string"), R.immunogenicity(F.col("text")))
    return repaired(t.fact_sheet).select("doc_id", F.array_join(groups, ", ").alias("assays"))


@check(
    "f31_reflex_by_text",
    "with d as (select doc_id, lower(string_agg(text, chr(10))) as t from protocol_line group by doc_id) "
    + " union all ".join(
        f"select doc_id, {quote(k)} as test, " + (f"case when {' or '.join(f'contains(t, {quote(w)})' for w in ws)} then {quote(v)} else 'No' end" if v else "'No'") + " as value from d"
        for k, (v, ws) in X.REFLEX_BY_TEXT.items()
    ),
    "protocol_line",
)
def _(t):
    return R.reflex_by_text(t.protocol_line)


@check(
    "f32_reflex_by_presence",
    f"with l as ({_LAB}) select distinct * from (" + " union all ".join(
        f"select doc_id, {quote(k)} as test, {quote(v)} as value from l where {' or '.join(f'contains(lower(analyte), {quote(w)})' for w in ws)}" for k, (v, ws) in X.REFLEX_BY_PRESENCE.items()
    ) + ") u",
    "protocol_line",
)
def _(t):
    return R.reflex_by_presence(_analytes(t).withColumnRenamed("analyte", "label"))


_FORMATS = ["%d-%b-%Y", "%d-%B-%Y", "%d %b %Y", "%d %B %Y", "%Y-%m-%d", "%b-%Y", "%B-%Y", "%b %Y", "%B %Y"]
_PARSE = "coalesce(" + ", ".join(f"try_strptime({{0}}, '{f}')" for f in _FORMATS) + ")"


@check("f33_parse_date_any", f"select doc_id, cast(cast({_PARSE.format('first_visit')} as date) as varchar) as first_visit, cast(cast({_PARSE.format('last_visit')} as date) as varchar) as last_visit from date_text", "date_text")
def _(t):
    return t.date_text.select("doc_id", *[DT.parse_date_any(F.col(c)).cast("string").alias(c) for c in ("first_visit", "last_visit")])


@check(
    "f33_normalize_written_date",
    f"""with d as (select doc_id, first_visit as x from date_text) select doc_id, case when regexp_matches(x, '(?i)(\\d{{1,2}})\\s*[- ]\\s*({X.MONTHS})\\s*[- ]\\s*(\\d{{4}})') then regexp_extract(x, '(\\d{{1,2}})', 1) || '-' || regexp_extract(x, '(?i)({X.MONTHS})', 1)[1:3] || '-' || regexp_extract(x, '(\\d{{4}})', 1)
    when regexp_matches(x, '(?i)({X.MONTHS})\\s*[- ]\\s*(\\d{{4}})') then regexp_extract(x, '(?i)({X.MONTHS})', 1)[1:3] || '-' || regexp_extract(x, '(\\d{{4}})', 1) end as written from d""",
    "date_text",
)
def _(t):
    return t.date_text.select("doc_id", DT.normalize_written_date(F.col("first_visit")).alias("written"))
