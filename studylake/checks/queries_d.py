"""Schedules."""

from pyspark.sql import functions as F

from studylake.checks.queries_c import _RANGES
from studylake.checks.registry import check
from studylake.checks.sqltext import cells_, quote
from studylake.functions import fixed as X
from studylake.functions.sequence import range_join
from studylake.functions.text import any_of
from studylake.operators import schedule as D
from studylake.sources.readers import to_pages

_VISIT = f"""case when lower(trim(text)) = '' then true when lower(trim(text)) in ({', '.join(quote(h) for h in X.NON_VISIT_HEADERS)}) then false
 else regexp_matches(trim(text), {quote(rf'(?i)^(?:{X.VISIT_TOKEN})(?:[\s,/&]+(?:{X.VISIT_TOKEN}))*$')}) or length(trim(text)) <= 8 end"""


def _non_lab(x: str) -> str:
    """The alternation without look-ahead: a term with one holds unless its tail also matches."""
    plain = [p for p in X.NON_LAB if "(?!" not in p]
    parts = [f"regexp_matches({x}, {quote(any_of(plain))})"]
    for p in X.NON_LAB:
        if "(?!" in p:
            head, tail = p.split("(?!", 1)
            parts.append(f"(regexp_matches({x}, {quote('(?i)' + head)}) and not regexp_matches({x}, {quote('(?i)' + head + tail[:-1])}))")
    return "(" + " or ".join(parts) + ")"


_DROP = f"(trim(text) <> '' and not regexp_matches(trim(text), {quote(any_of(X.KEEP_ROWS))}) and regexp_matches(trim(text), {quote(any_of(X.DROP_ROWS))}))"


@check("d1_is_visit_column", f"select doc_id, col_no, text, {_VISIT} as is_visit from visit_cell where row_no = 0", "visit_cell")
def _(t):
    heads = t.visit_cell.where("row_no = 0")
    return heads.select("doc_id", "col_no", "text", D.is_visit_column(F.col("text")).alias("is_visit"))


@check(
    "d2_is_category_header",
    f"""with r as (select doc_id, row_no, max(case when col_no = 0 then text end) as label, max(case when col_no > 0 and trim(text) <> '' then 1 else 0 end) as f from visit_cell where row_no > 0 group by doc_id, row_no)
    select doc_id, row_no, label from r where f = 0 and trim(label) <> '' and ((contains(trim(label), ' ') and regexp_matches(trim(label), {quote(X.DIVIDER_ENDING)})) or (upper(label) = label and lower(label) <> label and contains(trim(label), ' ') and length(trim(label)) between 4 and 50 and not {_non_lab('label')}))""",
    "visit_cell",
)
def _(t):
    return D.category_rows(t.visit_cell)


@check(
    "d3_drop_nonlab",
    f"select doc_id, row_no, col_no, text from (select *, bool_or(col_no = 0 and not {_non_lab('trim(text)')}) over (partition by doc_id, row_no) as keep from visit_cell) v where keep",
    "visit_cell",
)
def _(t):
    return D.drop_nonlab(t.visit_cell)


@check(
    "d4_drop_nonlab_keep_first",
    f"select doc_id, row_no, col_no, text from (select *, bool_or(col_no = 0 and not {_DROP}) over (partition by doc_id, row_no) as keep from visit_cell) v where keep",
    "visit_cell",
)
def _(t):
    return D.drop_nonlab_keep_first(t.visit_cell)


_CAP = "^(?:" + "|".join(X.CAPTION_WORDS) + ")"
_DAY = X.DAY_TOKEN.replace("±·", "±·")


def _piece(i: int, label: str, prev: str) -> str:
    p = f"coalesce(c[{i + 1}], '')"
    return f"({prev} and len(c) > {i} and {p} <> '' and upper({p}) <> 'X' and not regexp_matches({p}, {quote(_DAY)}) and length({p}) <= 12 and length({label}) + length({p}) <= 45)"


_MATRIX = f"""raw as (select doc_id, line_no, {cells_('text')} as c from matrix_line),
j1 as (select *, c[1] as l0, {_piece(1, 'c[1]', 'true')} as k1 from raw),
j2 as (select *, case when k1 then l0 || c[2] else l0 end as l1, {_piece(2, "(l0 || c[2])", 'k1')} as k2 from j1),
j3 as (select *, case when k2 then l1 || c[3] else l1 end as l2, {_piece(3, "(l1 || c[3])", 'k2')} as k3 from j2),
j4 as (select *, case when k3 then l2 || c[4] else l2 end as l3, {_piece(4, "(l2 || c[4])", 'k3')} as k4 from j3),
j5 as (select doc_id, line_no, c, case when k4 then l3 || c[5] else l3 end as label, cast(k1 as int) + cast(k2 as int) + cast(k3 as int) + cast(k4 as int) as used from j4),
m0 as (select doc_id, line_no, c as raw, label, list_concat([label], list_transform(range(used), lambda i: ''), c[used + 2:]) as cells,
 list_filter(c[2:], lambda x: x <> '') as fr, regexp_matches(array_to_string(c, ''), '^[-:\\s]*$') as sep from j5),
mx as (select *, cells[2:] as data, list_filter(cells[2:], lambda x: x <> '') as filled, case when sep then 'separator'
 when regexp_matches(raw[1], {quote(X.PAGE_CAPTION)}) or (regexp_matches(raw[1], '^[A-Za-z0-9]{{2,8}}$') and len(fr) > 0 and len(list_filter(fr, lambda x: not regexp_matches(lower(regexp_replace(x, '[/\\s]+$', '')), {quote(_CAP)}))) = 0) then 'decoration'
 when regexp_matches(label, {quote(X.GROUP_TITLE)}) then 'title' when lower(label) in ({', '.join(quote(h) for h in X.DAY_HEADER_LABELS)}) then 'day' else 'other' end as kind from m0)"""


@check("d5_drop_page_decoration", f"with {_MATRIX} select doc_id, line_no, array_to_string(raw, ';') as row from mx where kind <> 'decoration'", "matrix_line")
def _(t):
    rows = D.matrix_rows(t.matrix_line).where("kind <> 'decoration'")
    return rows.select("doc_id", "line_no", F.array_join("raw", ";").alias("row"))


_DAYLIKE = f"(label <> '' and len(filled) >= 3 and len(list_filter(filled, lambda x: regexp_matches(x, {quote(_DAY)}))) / len(filled) > 0.5)"


@check(
    "d6_is_day_header",
    f"with {_MATRIX} select doc_id, line_no, label, kind = 'day' as by_label, {_DAYLIKE} as by_shape from mx where kind in ('day', 'other') and (kind = 'day' or {_DAYLIKE})",
    "matrix_line",
)
def _(t):
    rows = D.matrix_rows(t.matrix_line).where("kind = 'day' or (kind = 'other' and day_like)")
    return rows.select("doc_id", "line_no", "label", (F.col("kind") == "day").alias("by_label"), F.col("day_like").alias("by_shape"))


_HEAD = f"""{_MATRIX}, w as (select *, lag(kind) over v as ak, lag(label) over v as al, lag(cells) over v as ac, last_value(case when kind = 'title' then label end ignore nulls) over v as title from mx window v as (partition by doc_id order by line_no)),
hm as (select *, {_DAYLIKE} as by_shape, case when ak = 'other' and al = '' and len(list_filter(ac[2:], lambda x: x <> '')) > 0 then list_concat([label], list_transform(range(1, greatest(len(cells), len(ac))), lambda i: trim(coalesce(ac[i + 1], '') || ' ' || coalesce(cells[i + 1], '')))) else cells end as merged from w),
hv as (select *, list_reverse(list_transform(range(len(merged)), lambda i: case when merged[i + 1] <> '' then i else -1 end)) as ix from hm),
hl as (select *, merged[2:list_max(ix) + 1] as names, list_max(ix) as n from hv),
first_ok as (select doc_id, min(line_no) as f from hl where n >= 1 and (kind = 'day' or (kind = 'other' and by_shape)) group by doc_id),
hd as (select h.doc_id, line_no, merged, title, names from hl h join first_ok o on h.doc_id = o.doc_id where n >= 1 and (kind = 'day' or (kind = 'other' and by_shape and line_no = f)))"""


@check("d7_merge_header_fragment", f"with {_HEAD} select doc_id, line_no, array_to_string(names, ';') as visits from hd", "matrix_line")
def _(t):
    rows = D.with_headers(D.matrix_rows(t.matrix_line)).where("is_header")
    return rows.select("doc_id", "line_no", F.array_join("header.visits", ";").alias("visits"))


@check(
    "d8_namespace_groups",
    f"with {_HEAD} select doc_id, line_no, array_to_string(list_transform(names, lambda v: case when title is null then v else title || ': ' || v end), ';') as visits from hd",
    "matrix_line",
)
def _(t):
    rows = D.named_rows(D.matrix_rows(t.matrix_line)).where("is_header")
    return rows.select("doc_id", "line_no", F.array_join("header.visits", ";").alias("visits"))


@check("d9_rejoin_label", f"with {_MATRIX} select doc_id, line_no, array_to_string(cells, ';') as row from mx where kind not in ('separator')", "matrix_line")
def _(t):
    rows = D.matrix_rows(t.matrix_line).where("kind <> 'separator'")
    return rows.select("doc_id", "line_no", F.array_join("cells", ";").alias("row"))


_CONT = "({0} <> '' and (regexp_matches({0}, '^\\p{{Ll}}') or length({0}) < 20))"
_DIVIDERS = rf"""{_HEAD}, dv0 as (select mx.*, hd.line_no is not null as is_header, row_number() over (partition by mx.doc_id order by mx.line_no) as rn, trim(raw[1]) as lr from mx left join hd on hd.doc_id = mx.doc_id and hd.line_no = mx.line_no),
dv1 as (select *, bool_or(is_header) over (partition by doc_id order by line_no) as headed, kind <> 'separator' and len(fr) = 0 and {_CONT.format('lr')} as cont from dv0),
dv2 as (select *, lead(lr) over v as l1, lead(lr, 2) over v as l2, lead(lr, 3) over v as l3, coalesce(lead(cont) over v, false) as c1, coalesce(lead(cont, 2) over v, false) as c2, coalesce(lead(cont, 3) over v, false) as c3 from dv1 window v as (partition by doc_id order by line_no)),
dv3 as (select *, case when c1 and c2 and c3 then 3 when c1 and c2 then 2 when c1 then 1 else 0 end as takes from dv2),
dv4 as (select *, trim(label || case when takes >= 1 then ' ' || l1 else '' end || case when takes >= 2 then ' ' || l2 else '' end || case when takes >= 3 then ' ' || l3 else '' end) as whole from dv3),
dv5 as (select *, kind = 'other' and not is_header and headed and len(filled) = 0 and label <> '' and ((contains(regexp_replace(whole, '\s*\([^)]*\)\s*$', ''), ' ') and regexp_matches(regexp_replace(whole, '\s*\([^)]*\)\s*$', ''), {quote(X.DIVIDER_ENDING)}))
 or (upper(whole) = whole and lower(whole) <> whole and contains(whole, ' ') and length(whole) between 4 and 50 and not {_non_lab('whole')})) as opens from dv4),
st as (select distinct doc_id, cast(0 as bigint) as rn, 0 as remaining, false as divider from dv5 union all
 select d.doc_id, d.rn, case when d.cont and st.remaining > 0 then st.remaining - 1 when d.opens then d.takes else 0 end, d.opens or (d.cont and st.remaining > 0) from st join dv5 d on d.doc_id = st.doc_id and d.rn = st.rn + 1),
dv as (select dv5.*, st.divider from dv5 join st on st.doc_id = dv5.doc_id and st.rn = dv5.rn)"""


@check("d10_drop_dividers_lookahead", f"with recursive {_DIVIDERS} select doc_id, line_no, label from dv where divider", "matrix_line")
def _(t):
    rows = D.drop_dividers(D.with_headers(D.matrix_rows(t.matrix_line)))
    return rows.where("divider").select("doc_id", "line_no", "label")


@check(
    "d11_drop_repeated_rows",
    f"""with {_MATRIX}, s as (select doc_id, line_no, array_to_string(list_filter(raw, lambda x: x <> ''), chr(1)) as sig from mx), n as (select *, count(*) over (partition by doc_id, sig) as n from s)
    select doc_id, line_no from n where n < 3""",
    "matrix_line",
)
def _(t):
    return D.drop_repeated(D.matrix_rows(t.matrix_line)).where("not repeated").select("doc_id", "line_no")


@check(
    "d12_merge_continuations",
    """with m as (select doc_id, table_ord, row_ord, max(label) as label, string_agg(mark, ';' order by visit_ord) as marks, max(comment) as comment, bool_and(mark = '') as blank from mark group by doc_id, table_ord, row_ord),
    g as (select *, coalesce(last_value(case when not (blank and length(label) < 20) then row_ord end ignore nulls) over v, min(row_ord) over v) as r from m window v as (partition by doc_id, table_ord order by row_ord))
    select doc_id, table_ord, r as row_ord, string_agg(label, ' ' order by row_ord) as label, min_by(marks, row_ord) as marks, array_to_string(list_filter(list(comment order by row_ord), lambda x: x <> ''), ' ') as comment from g group by doc_id, table_ord, r""",
    "mark",
)
def _(t):
    marks = F.transform(F.sort_array(F.collect_list(F.struct("visit_ord", "mark"))), lambda s: s["mark"])
    rows = t.mark.groupBy("doc_id", F.col("table_ord").alias("table_key"), F.col("row_ord").alias("line_no")).agg(
        F.max("label").alias("label"), marks.alias("marks"), F.max("comment").alias("comment"), F.array(F.lit("v")).alias("visits")
    )
    out = D.merge_continuations(rows)
    return out.select("doc_id", F.col("table_key").alias("table_ord"), "row_ord", "label", F.array_join("marks", ";").alias("marks"), "comment")


_TABLES = rf"""{_DIVIDERS}, ti as (select doc_id, line_no, is_header, last_value(case when kind = 'title' and not divider then label end ignore nulls) over (partition by doc_id order by line_no) as title from dv),
hn as (select hd.doc_id, hd.line_no, dv.kind = 'day' as day, list_transform(hd.names, lambda v: case when ti.title is null then v else ti.title || ': ' || v end) as visits from hd join dv on dv.doc_id = hd.doc_id and dv.line_no = hd.line_no join ti on ti.doc_id = hd.doc_id and ti.line_no = hd.line_no),
to_ as (select doc_id, visits, min(line_no) as table_ord from hn group by all),
rw as (select dv.*, count(*) over (partition by dv.doc_id, array_to_string(list_filter(raw, lambda x: x <> ''), chr(1))) as times,
 coalesce(last_value(case when hn.day then hn.visits end ignore nulls) over v, first_value(case when not hn.day then hn.visits end ignore nulls) over v) as visits from dv left join hn on hn.doc_id = dv.doc_id and hn.line_no = dv.line_no window v as (partition by dv.doc_id order by dv.line_no)),
da as (select doc_id, line_no, label, visits, list_transform(range(len(visits)), lambda i: trim(coalesce(cells[i + 2], ''))) as marks, array_to_string(list_filter(list_transform(cells[len(visits) + 2:], lambda x: trim(x)), lambda x: x <> ''), ' ') as comment
 from rw where kind = 'other' and not is_header and visits is not null and not divider and times < 3 and label <> '' and not (regexp_matches(label, {quote(X.PAGE_CAPTION)})
  or (regexp_matches(label, '^[A-Za-z0-9]{{2,8}}$') and len(filled) > 0 and len(list_filter(filled, lambda x: not regexp_matches(lower(regexp_replace(x, '[/\s]+$', '')), {quote(_CAP)}))) = 0))),
gr as (select *, coalesce(last_value(case when not (len(list_filter(marks, lambda m: m <> '')) = 0 and {_CONT.format('label')}) then line_no end ignore nulls) over v, min(line_no) over v) as row_ord from da window v as (partition by doc_id, visits order by line_no)),
mg as (select doc_id, visits, row_ord, string_agg(label, ' ' order by line_no) as label, min_by(marks, line_no) as marks, array_to_string(list_filter(list(comment order by line_no), lambda x: x <> ''), ' ') as comment from gr group by doc_id, visits, row_ord)"""


@check(
    "d13_assign_table_key",
    f"with recursive {_TABLES} select mg.doc_id, table_ord, row_ord, label, array_to_string(mg.visits, ';') as visits, array_to_string(marks, ';') as marks, comment from mg join to_ on to_.doc_id = mg.doc_id and to_.visits = mg.visits",
    "matrix_line",
)
def _(t):
    rows = D.schedule_rows(t.matrix_line)
    return rows.select("doc_id", "table_ord", "row_ord", "label", F.array_join("visits", ";").alias("visits"), F.array_join("marks", ";").alias("marks"), "comment")


@check(
    "d14_union_visits",
    "with s as (select *, row_number() over (partition by doc_id, visit order by table_ord, visit_ord) as k from mark) select doc_id, visit, table_ord, visit_ord from s where k = 1",
    "mark",
)
def _(t):
    return D.union_visits(t.mark)


_MERGED = "merged as (select doc_id, label, visit, mark from (select *, row_number() over (partition by doc_id, label, visit order by table_ord, row_ord, visit_ord) as k from mark where mark <> '') s where k = 1)"


@check("d15_merge_rows_by_label", f"with {_MERGED} select * from merged", "mark")
def _(t):
    return D.merge_rows_by_label(t.mark)


@check(
    "d15_merge_comments",
    """with d as (select doc_id, label, comment, min(table_ord * 1000 + row_ord) as at_ from mark group by all)
    select doc_id, label, min(at_) // 1000 as table_ord, min(at_) % 1000 as row_ord, coalesce(string_agg(comment, ' ' order by at_) filter (where comment <> ''), '') as comment from d group by doc_id, label""",
    "mark",
)
def _(t):
    return D.merge_comments(t.mark.select("doc_id", "table_ord", "row_ord", "label", "comment").distinct())


_V = ["Visit 1", "Visit 2", "Visit 3", "Visit 9"]


@check(
    "d16_pivot_matrix",
    f"with {_MERGED} select doc_id, label, " + ", ".join(f"coalesce(max(case when visit = '{v}' then mark end), '') as \"{v}\"" for v in _V) + " from merged group by doc_id, label",
    "mark",
)
def _(t):
    return D.pivot_matrix(D.merge_rows_by_label(t.mark), _V)


@check("d16_unpivot_matrix", f"with {_MERGED} select * from merged", "mark")
def _(t):
    return D.unpivot_matrix(D.pivot_matrix(D.merge_rows_by_label(t.mark), _V), _V)


@check("d17_count_visits", f"select doc_id, count(*) filter (where {_VISIT}) as visits from visit_cell where row_no = 0 and col_no > 0 group by doc_id", "visit_cell")
def _(t):
    return D.count_visits(t.visit_cell)


@check("d18_select_row_positions", "select c.* from visit_cell c join (select distinct l_orderkey, l_linenumber from item where l_returnflag = 'R') i on c.doc_id = i.l_orderkey and c.row_no = i.l_linenumber", "visit_cell", "item")
def _(t):
    chosen = t.item.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row_no"))
    return D.select_row_positions(t.visit_cell, chosen)


@check(
    "d19_appendix_rows_with_review",
    rf"""with a as (select doc_id, line_no, trim(text) as text, text like '|%' and not regexp_matches(text, '^[|:\s-]*$') and not regexp_matches(text, '(?i)^\|\s*clinical laboratory tests') as r from appendix_line where trim(text) <> ''),
    p as (select *, coalesce(last_value(case when r then line_no end ignore nulls) over (partition by doc_id order by line_no), -1) as prev from a),
    s as (select doc_id, prev, min(line_no) as line_no, string_agg(regexp_replace(text, '^#+\s*', ''), ' ' order by line_no) as comment from p where text not like '|%' and not regexp_matches(text, '(?i)^Page\s+\d+\s+of') group by doc_id, prev)
    select doc_id, line_no, split_part(text, ' | ', 1)[3:] as test, array_to_string(list_filter({cells_('text')}[2:], lambda x: x <> ''), ' ') as comment from p where r
    union all select doc_id, line_no, {quote(D.REVIEW_ROW)}, comment from s where length(comment) >= 60""",
    "appendix_line",
)
def _(t):
    return D.appendix_rows_with_review(t.appendix_line)


_SCHED = rf"""{_RANGES}, sl as (select m.doc_id, line_no, text, list_filter(list_transform(regexp_split_to_array(trim(text), '\s{{2,}}'), lambda x: trim(x)), lambda x: x <> '') as p from mapper_line m join rg on m.doc_id = rg.doc_id and line_no >= schedule_start and line_no < schedule_end),
vn as (select doc_id, line_no as at_, list_transform(list_filter(p, lambda x: regexp_matches(x, '^\d+$')), lambda x: cast(x as int)) as v from sl where contains(upper(text), 'VISIT NUMBER')),
st as (select sl.doc_id, p[1] as name, line_no, list_filter(list_transform(p[2:], lambda x, i: case when regexp_matches(x, '\bX\b') then v[i] end), lambda x: x is not null) as visits, list_filter(p[2:], lambda x: regexp_matches(x, '\bX\b')) as xs
 from sl join vn on sl.doc_id = vn.doc_id where len(p) >= 2 and not regexp_matches(p[1], '(?i)^(visit\s*number|weeks?)') and not contains(p[1], 'Laboratory tests and sample') and length(p[1]) > 2),
tests as (select doc_id, name, max(line_no) as line_no, regexp_matches(lower(name), 'hematology|chemistry|lipids|urinalysis|panel|serology|hormones|antibody|testing') as is_panel, max_by(visits, line_no) as visits from st where len(xs) > 0 group by doc_id, name)"""


@check("d20_parse_schedule_lines", f"with {_SCHED} select doc_id, name, line_no, is_panel, array_to_string(visits, ',') as visits from tests", "mapper_line")
def _(t):
    tests, _ = D.schedule_parts(t.mapper_line)
    return tests.select("doc_id", "name", "line_no", "is_panel", F.array_join(F.transform("visits", lambda v: v.cast("string")), ",").alias("visits"))


_CLEAN = r"""case when text = '' or regexp_matches(text, '^(If |Performed|-)') or regexp_matches(text, '^\d+\s+\w') or regexp_matches(text, '(?i)assayed\s+by\s+\w+[-\s]?designated\s+laboratory') or regexp_matches(upper(text), 'CONFIDENTIAL|APPROVED ON') then null when regexp_matches(text, '^[A-Z][a-zA-Z\-\s]+$') and length(text) > 2 then text
 when regexp_matches(text, '^[A-Z][a-zA-Z\-.]+(\s|$)') and length(split_part(text, ' ', 1)) > 2 and split_part(text, ' ', 1) not in ('The', 'And', 'For', 'Not', 'See', 'With', 'That', 'This', 'Evaluated', 'Collected') then regexp_replace(trim(split_part(split_part(split_part(text, '(', 1), ',', 1), '  ', 1)), '\s+If\s+.*$', '') end"""
_PANEL = rf"""{_SCHED}, ll as (select m.doc_id, line_no, trim(text) as text, regexp_matches(text, '(?i)assayed\s+by\s+\w+[-\s]?designated\s+laboratory') as mk from mapper_line m join rg on m.doc_id = rg.doc_id and line_no >= lab_start and line_no < lab_end),
lw as (select *, mk and coalesce(lead(mk) over v, false) as alone, last_value(case when mk then line_no end ignore nulls) over v as panel_no, last_value(case when mk then trim(regexp_replace(split_part(text, 'assayed', 1), ':\s*$', '')) end ignore nulls) over v as name from ll window v as (partition by doc_id order by line_no)),
pl as (select doc_id, panel_no, name, line_no, alone, case when not mk then {_CLEAN} end as test, mk from lw where panel_no is not null),
panels as (select doc_id, panel_no, name, bool_or(alone) as is_standalone, coalesce(list(test order by line_no) filter (where test is not null), []) as tests from pl group by doc_id, panel_no, name),
rp as (select p.doc_id, p.panel_no, p.name, is_standalone, case when is_standalone and t.name is not null then [p.name] else tests end as tests from panels p left join tests t on p.doc_id = t.doc_id and p.name = t.name and not t.is_panel)"""


def _flat(df):
    return df.select("doc_id", "panel_no", "name", "is_standalone", F.array_join("tests", ";").alias("tests"))


@check("d21_parse_panels", f"with {_PANEL} select doc_id, panel_no, name, is_standalone, array_to_string(tests, ';') as tests from panels", "mapper_line")
def _(t):
    labs = D.detect_line_ranges(t.mapper_line).where("lab_start is not null").select("doc_id", "lab_start", "lab_end")
    return _flat(D.parse_panels(range_join(t.mapper_line, labs, ["doc_id"], "line_no", "lab_start", "lab_end").select(*t.mapper_line.columns)))


@check("d22_clean_analyte_name", f"with l as (select doc_id, line_no, trim(text) as text from mapper_line) select doc_id, line_no, {_CLEAN} as test from l", "mapper_line")
def _(t):
    return t.mapper_line.select("doc_id", "line_no", D.clean_analyte_name(F.col("text")).alias("test"))


@check("d23_is_likely_panel", "select p_partkey, regexp_matches(lower(p_name || ' ' || p_type), 'hematology|chemistry|lipids|urinalysis|panel|serology|hormones|antibody|testing') as is_panel from part")
def _(t):
    return t.part.select("p_partkey", D.is_likely_panel(F.concat_ws(" ", "p_name", "p_type")).alias("is_panel"))


@check("d24_resolve_standalone", f"with {_PANEL} select doc_id, panel_no, name, is_standalone, array_to_string(tests, ';') as tests from rp", "mapper_line")
def _(t):
    return _flat(D.schedule_parts(t.mapper_line)[1])


@check(
    "d25_visit_to_tests",
    f"with {_SCHED}, u as (select distinct doc_id, name, unnest(visits) as visit from tests) select doc_id, visit, string_agg(name, ';' order by name) as tests from u group by doc_id, visit",
    "mapper_line",
)
def _(t):
    return D.visit_to_tests(D.schedule_parts(t.mapper_line)[0]).select("doc_id", "visit", F.array_join("tests", ";").alias("tests"))


@check(
    "d26_consolidated_schedule",
    f"""with {_PANEL}, bn as (select doc_id, lower(trim(name)) as k, min_by(name, panel_no) as panel from rp group by all),
    r1 as (select t.doc_id, coalesce(bn.panel, 'Other') as category, t.name as test, visits from tests t left join bn on t.doc_id = bn.doc_id and lower(t.name) = bn.k),
    an as (select doc_id, panel_no, name, unnest(case when len(tests) > 0 then tests when is_standalone then [name] else [] end) as test, unnest(range(case when len(tests) > 0 then len(tests) when is_standalone then 1 else 0 end)) as n from rp),
    fr as (select *, row_number() over (partition by doc_id, lower(test) order by panel_no, n) as k from an a where not exists (select 1 from tests t where t.doc_id = a.doc_id and lower(t.name) = lower(a.test))),
    r2 as (select f.doc_id, f.name as category, f.test, coalesce(t.visits, []) as visits from fr f left join tests t on t.doc_id = f.doc_id and lower(t.name) = lower(f.name) where k = 1)
    select doc_id, category, test, array_to_string(visits, ',') as visits from r1 union all select doc_id, category, test, array_to_string(visits, ',') from r2""",
    "mapper_line",
)
def _(t):
    rows = D.consolidated_schedule(*D.schedule_parts(t.mapper_line))
    return rows.select("doc_id", "category", "test", F.array_join(F.transform("visits", lambda v: v.cast("string")), ",").alias("visits"))


@check(
    "d27_schedule_json",
    f"""with {_PANEL}, te as (select doc_id, list({{'name': name, 'is_panel': is_panel, 'visits': visits}} order by name, is_panel, visits) as l from tests group by doc_id),
    pn as (select doc_id, list({{'name': name, 'is_standalone': is_standalone, 'tests': tests}} order by panel_no, name, is_standalone) as l from rp group by doc_id),
    vt as (select doc_id, visit, list(distinct name order by name) as names from (select doc_id, name, unnest(visits) as visit from tests) u group by doc_id, visit),
    vs as (select doc_id, list({{'visit_number': visit, 'tests': names}} order by visit) as l from vt group by doc_id), ds as (select doc_id from te union select doc_id from pn union select doc_id from vs)
    select ds.doc_id, '{{"schedule_of_activities":{{' || coalesce('"tests":' || to_json(te.l), '') || '}},"lab_appendix":{{' || coalesce('"panels":' || to_json(pn.l), '') || '}}' || coalesce(',"master_schedule":' || to_json(vs.l), '') || '}}' as json
    from ds left join te on te.doc_id = ds.doc_id left join pn on pn.doc_id = ds.doc_id left join vs on vs.doc_id = ds.doc_id""",
    "mapper_line",
)
def _(t):
    return D.schedule_json(*D.schedule_parts(t.mapper_line))


def _combine(name: str, drop: str, key: str = "trim(coalesce(cs[0], '')) <> ''") -> str:
    return f"""with k as (select doc_id, {name} as name, table_ord, row_no, col_no, text from page_cell where text is not null),
    rw as (select doc_id, name, table_ord, row_no, max(col_no) + 1 as n, map_from_entries(list((col_no, text))) as cs from k group by doc_id, name, table_ord, row_no),
    b as (select *, max(n) over v as w, arg_min(cs, table_ord) filter (where row_no = 0) over v as hc from rw window v as (partition by doc_id, name)),
    f as (select *, coalesce(cs[0], '') as text from b where row_no > 0), u as (select *, unnest(range(w)) as col_no from f where {key} and not ({drop}))
    select doc_id, name, table_ord, row_no, col_no, coalesce(nullif(hc[cast(col_no as int)], ''), 'Column ' || (col_no + 1)) as "column", coalesce(cs[cast(col_no as int)], '') as text from u"""


@check("d28_combine_page_tables", _combine("trim(table_name)", f"name = 'SoA' and {_DROP}"), "page_cell")
def _(t):
    return D.combine_page_tables(t.page_cell)


@check("d28_skipped_pages", "select doc_id, page from page_cell group by doc_id, page having count(text) = 0", "page_cell")
def _(t):
    return D.skipped_pages(t.page_cell)


@check("d29_merge_named_tables", _combine("lower(trim(table_name))", "false", "true"), "page_cell")
def _(t):
    return D.merge_named_tables(t.page_cell)


@check(
    "d30_merge_page_blocks",
    """with b as (select doc_id, page, block_no, html, row_number() over (partition by doc_id, page order by top, block_no) - 1 as o from page_block where html is not null),
    r as (select doc_id, page, o * 2 as row_no, [regexp_extract(html, '<tr><td>(.*?)</td>', 1), 'a & b'] as c from b union all select doc_id, page, o * 2 + 1, ['row two', ''] from b),
    u as (select *, unnest([0, 1]) as col_no from r) select doc_id, page, row_no, col_no, c[col_no + 1] as text from u""",
    "page_block",
)
def _(t):
    return D.merge_page_blocks(to_pages(t.page_block))


@check("d31_choose_table_source", "with m as (select doc_id, min(layer) as layer from candidate group by doc_id) select c.doc_id, c.layer, field, tier from candidate c join m on c.doc_id = m.doc_id and c.layer = m.layer", "candidate")
def _(t):
    return D.choose_source(t.candidate, ["doc_id"], "layer").select("doc_id", "layer", "field", "tier")
