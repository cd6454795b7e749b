"""Evidence."""

from pyspark.sql import functions as F

from studylake.checks.registry import check
from studylake.checks.sqltext import clip_, match_, quote, squeeze_
from studylake.operators import evidence as G
from studylake.operators import structure as S

_SPACE = f"sp as (select doc_id, {squeeze_('substring(text, 1, instr(text, chr(10) || ' + quote('9.2.') + ') - 1)')} as t from tissue)"


def _first(e) -> str:
    return "case " + " ".join(f"when {match_('t', '(?i)' + p)} then regexp_extract(t, {quote('(?i)' + p)}, 0)" for p in e.patterns) + " end"


def _value(e) -> str:
    m = _first(e)
    if e.kind == "yes":
        return f"case when {m} is not null then 'Yes' end"
    if e.kind == "slides":
        tails = [" || ' unstained slides'", " || ' thick'", " || ' thick'"]
        return "case " + " ".join(f"when {match_('t', '(?i)' + p)} then regexp_extract(t, {quote('(?i)' + p)}, 1){x}" for p, x in zip(e.patterns, tails)) + " end"
    if e.kind == "sentence":
        return f"case when instr({m}, '. ') between 1 and {e.width} then substring({m}, 1, instr({m}, '. ')) else {clip_(m, e.width)} end"
    return clip_(m, e.width)


_EV = _SPACE + ", ev as (" + " union all ".join(
    f"select doc_id, {i} as ord, {quote(e.label)} as label, {_value(e)} as value, '{e.confidence}' as confidence from sp" for i, e in enumerate(G.CATALOG)
) + "), found as materialized (select * from ev where value is not null)"


_WORDS = ["the ", "and", "tion"]
_WINDOWS = " union all ".join(
    f"select doc_id, text, {i} as k, {len(w)} as len, unnest(list_transform(range(1, len(p)), lambda j: list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * {len(w)} + 1)) as pos from (select doc_id, text, string_split(lower(text), {quote(w)}) as p from documents) d"
    for i, w in enumerate(_WORDS)
)


@check(
    "g1_keyword_windows",
    f"""with h as ({_WINDOWS}), w as (select doc_id, k, pos, {squeeze_("substring(text, cast(greatest(pos - 40, 1) as bigint), cast(pos + len + 40 - greatest(pos - 40, 1) as bigint))")} as win from h),
    o as (select *, row_number() over (partition by doc_id, lower(substring(win, 1, 150)) order by k, pos) as nth from w)
    select doc_id, row_number() over (partition by doc_id order by k, pos) - 1 as ord, win as "window" from o where nth = 1""",
)
def _(t):
    windows = S.keyword_windows(F.col("text"), _WORDS, 40)
    return t.documents.select("doc_id", F.posexplode(windows).alias("ord", "window"))


def _evidence(t):
    return G.evidence_catalog(G.tissue_sections(t.tissue))


@check("g2_evidence_catalog", f"with {_EV} select doc_id, ord, label, value, confidence from found", "tissue")
def _(t):
    return _evidence(t).drop("evidence")


def _evidence_sql(e) -> str:
    m = _first(e)
    if e.kind != "yes":
        return squeeze_(m)
    at = f"instr(t, regexp_extract(t, {quote('(?i)' + e.patterns[0])}, 0))"
    left = f"greatest({at} - 250, 1)"
    return squeeze_(f"substring(t, {left}, {at} + length({m}) + 450 - {left})")


_TEXTS = _EV.replace(", ev as (", ", tx as (" + " union all ".join(f"select doc_id, {i} as ord, {_evidence_sql(e)} as evidence from sp" for i, e in enumerate(G.CATALOG)) + "), ev as (", 1)


@check("g2_evidence_text", f"with {_TEXTS} select f.doc_id, label, evidence from found f join tx on f.doc_id = tx.doc_id and f.ord = tx.ord", "tissue")
def _(t):
    return _evidence(t).select("doc_id", "label", "evidence")


@check("g3_slide_value", f"with {_EV} select doc_id, value from found where label = {quote(G.SLIDES)}", "tissue")
def _(t):
    sections = G.tissue_sections(t.tissue)
    return sections.select("doc_id", G.slide_value(F.col("section")).alias("value")).where("value is not null")


def _v(label: str) -> str:
    return f"max(case when label = {quote(label)} then value end)"


def _answer(i: int, label: str | None, default: str) -> str:
    at = {e.label: f"v{k}" for k, e in enumerate(G.CATALOG)}
    return {
        0: "concat_ws(' ', coalesce(nullif(concat_ws(' ', case when v0 is not null then 'Tumor tissue samples are described for biomarker assessment.' end, v3, v4, case when v10 is not null then 'Optional tumor tissue collection at disease progression is described.' end, v6), ''), 'TBC - no explicit oncology tumor tissue language found.'), v6, v7)",
        1: "case when v9 is not null then 'Archived tumor tissue availability is referenced during screening.' else 'TBC / per Protocol and Lab Manual' end || case when v10 is not null then ' Optional new tissue at progression may also apply.' else '' end",
        5: f"case when v3 is not null and v4 is not null then v3 || ' If block unavailable: ' || v4 else coalesce(v3, v4, {quote(G.MANUAL)}) end",
    }.get(i, f"coalesce({at[label]}, {quote(default)})" if label else quote(default))


_ANSWERS = f"w as (select d.doc_id, {', '.join(f'{_v(e.label)} as v{i}' for i, e in enumerate(G.CATALOG))} from tissue d left join found f on d.doc_id = f.doc_id group by d.doc_id), an as (" + " union all ".join(
    f"select doc_id, {i} as ord, {quote(q)} as question, {_answer(i, label, default)} as answer from w" for i, (q, label, default) in enumerate(G.ANSWERS)
) + ")"


@check("g4_evidence_to_answers", f"with {_EV}, {_ANSWERS} select doc_id, ord, answer from an", "tissue")
def _(t):
    return G.evidence_to_answers(t.tissue, _evidence(t)).select("doc_id", "ord", "answer")


@check("g4_all_answers", f"with {_EV}, {_ANSWERS} select * from an", "tissue")
def _(t):
    return G.evidence_to_answers(t.tissue, _evidence(t))


_FLAGS = "fl as (" + " union all ".join(
    f"select doc_id, {i} as ord, {quote(f)} as flag from tissue where doc_id not in (select doc_id from found where label = {quote(l)})" for i, (l, f) in enumerate(G.REQUIRED.items())
) + f" union all select doc_id, {len(G.REQUIRED)}, {quote(G.NOTHING)} from tissue where doc_id not in (select doc_id from found))"


@check(
    "g5_missing_evidence_flags",
    f"with {_EV}, {_FLAGS} select * from fl",
    "tissue",
)
def _(t):
    return G.missing_evidence_flags(t.tissue, _evidence(t))


_NL = "chr(10)"
_PARTS = f"""e as (select f.doc_id, string_agg('### ' || label || {_NL} || '- **Value:** ' || value || {_NL} || '- **Confidence:** ' || confidence || {_NL} || '- **Evidence:** ' || {clip_('evidence', 700)} || {_NL}, {_NL} order by f.ord) as e from found f join tx on f.doc_id = tx.doc_id and f.ord = tx.ord group by f.doc_id),
a as (select doc_id, string_agg('### ' || question || {_NL} || answer || {_NL}, {_NL} order by ord) as a from an group by doc_id), g as (select doc_id, string_agg('- ' || flag, {_NL} order by ord) as g from fl group by doc_id)"""


@check(
    "g6_evidence_report",
    f"""with {_TEXTS}, {_ANSWERS}, {_FLAGS}, {_PARTS} select sp.doc_id, concat_ws({_NL} || {_NL}, '# Oncology Biopsy / Tumor Tissue Extraction', '**Relevant section detected:** 9.1. Tumor Tissue Samples', '## Relevant excerpt' || {_NL} || {_NL} || t,
      '## Evidence found' || {_NL} || {_NL} || coalesce(e, 'No direct biopsy / tumor tissue evidence found.'), '## Suggested answers' || {_NL} || {_NL} || a, '## Manual review flags' || {_NL} || {_NL} || g) as report
    from sp left join e on e.doc_id = sp.doc_id left join a on a.doc_id = sp.doc_id left join g on g.doc_id = sp.doc_id""",
    "tissue",
)
def _(t):
    sections = G.tissue_sections(t.tissue)
    found = G.evidence_catalog(sections)
    return G.evidence_report(sections, found, G.evidence_to_answers(t.tissue, found), G.missing_evidence_flags(t.tissue, found))
