"""Lines, headings, sections, tables."""

from pyspark.sql import functions as F

from studylake.checks.registry import check
from studylake.checks.sqltext import cells_, quote, squeeze_, strip_
from studylake.functions.fixed import CHANGE_LOG, QUESTION_SECTIONS, SCHEDULE_END, SCHEDULE_START
from studylake.functions.text import repaired
from studylake.operators import structure as S

_LINES = """lines as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'n': i - 1, 't': x})) as u from documents)"""


@check(
    "c1_explode_lines",
    f"""with {_LINES} select doc_id, u.n as line_no, u.t as text, cast(coalesce(sum(length(u.t) + 1) over (partition by doc_id order by u.n rows between unbounded preceding and 1 preceding), 0) as bigint) as offset_chars from lines""",
)
def _(t):
    return S.line_offsets(S.explode_lines(t.documents)).withColumnRenamed("offset", "offset_chars")


@check("c2_toc_lines", "select doc_id, line_no from protocol_line where regexp_matches(text, '\\.{4,}')", "protocol_line")
def _(t):
    return t.protocol_line.where(S.is_toc_line(F.col("text"))).select("doc_id", "line_no")


_HEADS = r"""heads as (select doc_id, line_no, regexp_extract(trim(text), '^(#{1,6})?\s*(\d+(?:\.\d+)*)\.\s', 2) as number, length(regexp_extract(trim(text), '^(#{1,6})?\s*(\d+(?:\.\d+)*)\.\s', 1)) as hashes, trim(text) as heading
 from protocol_line where regexp_matches(trim(text), '^(#{1,6})?\s*(\d+(?:\.\d+)*)\.\s') and not regexp_matches(text, '\.{4,}')),
heads2 as (select *, case when hashes > 0 then hashes else len(string_split(number, '.')) end as level from heads)"""


@check("c3_detect_headings", f"with {_HEADS} select doc_id, line_no, number, level, hashes, heading from heads2", "protocol_line")
def _(t):
    return S.detect_headings(t.protocol_line)


@check(
    "c4_find_heading",
    f"""with {_HEADS}, r as (select *, row_number() over (partition by doc_id order by case when number = '10' then 0 else 1 end, line_no) as k from heads2 where number = '10' or split_part(number, '.', 1) = '10')
    select doc_id, line_no, number, level, hashes, heading from r where k = 1""",
    "protocol_line",
)
def _(t):
    return S.find_heading(S.detect_headings(t.protocol_line), "10")


_BOUNDS = rf"""{_HEADS}, st as (select doc_id, min(line_no) as s, min_by(level, line_no) as lv, min_by(hashes, line_no) as hs from heads2 where number = '1.3' group by doc_id),
b as (select st.doc_id, s, (select min(p.line_no) from protocol_line p where p.doc_id = st.doc_id and p.line_no > s and not regexp_matches(text, '\.{{4,}}')
  and ((hs > 0 and regexp_matches(trim(text), '^#{{1,6}}\s+\d') and length(regexp_extract(trim(text), '^#+', 0)) <= lv)
    or (hs = 0 and regexp_matches(trim(text), '^\d+(?:\.\d+)*\.\s') and len(string_split(regexp_extract(trim(text), '^(\d+(?:\.\d+)*)\.\s', 1), '.')) <= lv))) as e from st)"""


@check(
    "c5_extract_section",
    f"with {_BOUNDS} select p.doc_id, line_no, text from protocol_line p join b on p.doc_id = b.doc_id and line_no >= s and (e is null or line_no < e)",
    "protocol_line",
)
def _(t):
    return S.extract_section(t.protocol_line, "1.3", "1")


@check(
    "c6_between_landmarks",
    """with s as (select doc_id, text, instr(lower(text), 'the ') as b from documents), r as (select doc_id, b, substring(text, case when b = 0 then 1 else b end) as tail from s)
    select doc_id, case when b = 0 then null when instr(lower(tail), '. and') > 0 then substring(tail, 1, instr(lower(tail), '. and') - 1) else tail end as text from r""",
)
def _(t):
    return t.documents.select("doc_id", S.between_landmarks(F.col("text"), "the ", ". and").alias("text"))


_SECT = rf"""bare as (select *, trim(regexp_replace(regexp_replace(trim(text), '^\|', ''), '\|$', '')) as bare from design_line),
hd as (select *, regexp_matches(bare, '^(\d+(?:\.\d+)*)\.\s+(.+)$') as h, regexp_extract(bare, '^(\d+(?:\.\d+)*)\.\s+(.+)$', 1) as num, trim(regexp_extract(bare, '^(\d+(?:\.\d+)*)\.\s+(.+)$', 2)) as ttl from bare),
sec as (select doc_id, line_no, text, h, case when h and contains(text, '|') and contains(ttl, '|') then nullif(trim(rtrim(regexp_replace(ttl, '^[^|]*\|', ''), '|')), '') end as cell,
 last_value(case when h then line_no end ignore nulls) over w as start_line, last_value(case when h then num end ignore nulls) over w as number,
 last_value(case when h then case when contains(text, '|') and contains(ttl, '|') then trim(split_part(ttl, '|', 1)) else ttl end end ignore nulls) over w as title,
 last_value(case when h then case when contains(num, '.') then 2 else 1 end end ignore nulls) over w as level,
 last_value(case when h and not contains(num, '.') then num end ignore nulls) over w as top
 from hd window w as (partition by doc_id order by line_no)),
sl as (select doc_id, start_line, number, case when level = 2 then top end as parent_number, title, level, line_no, case when h then cell else text end as text from sec where top is not null),
full_sec as (select doc_id, start_line, number, parent_number, title, level, coalesce({strip_("string_agg(text, chr(10) order by line_no)")}, '') as text from sl group by all)"""


@check("c7_parse_sections", f"with {_SECT} select * from full_sec", "design_line")
def _(t):
    return S.parse_sections(t.design_line)


@check("c7_section_lines", f"with {_SECT} select * from sl", "design_line")
def _(t):
    return S.section_lines(t.design_line)


@check("c8_section_body", f"with {_SECT} select * from sl where level = 1 and text is not null", "design_line")
def _(t):
    return S.section_body(t.design_line)


@check(
    "c9_find_section_by",
    f"""with {_SECT}, r as (select doc_id, start_line, number, title, row_number() over (partition by doc_id order by case when number = '46' then 0 else 1 end, start_line) as k from full_sec where number = '46' or contains(lower(title), 'country'))
    select doc_id, start_line, number, title from r where k = 1""",
    "design_line",
)
def _(t):
    return S.find_section_by(S.section_lines(t.design_line), "46", "Country")


@check(
    "c10_find_page_range",
    f"""with w as (select *, text || coalesce(lead(text) over (partition by doc_id order by page), '') as win, contains(text, '........') as toc from protocol_page),
    f as (select doc_id, min(case when regexp_matches(text, {quote(SCHEDULE_START)}) and not toc and not regexp_matches(win, {quote(CHANGE_LOG)}) then page end) as s, max(page) as last from w group by doc_id),
    e as (select f.doc_id, min(w.page) - 1 as e from f join w on f.doc_id = w.doc_id and w.page > f.s and regexp_matches(text, {quote(SCHEDULE_END)}) and not toc group by f.doc_id)
    select f.doc_id, s as start_page, case when e >= s then e else last end as end_page from f left join e on f.doc_id = e.doc_id where s is not null""",
    "protocol_page",
)
def _(t):
    return S.find_page_range(t.protocol_page, SCHEDULE_START, SCHEDULE_END)


_RANGES = f"""f as (select doc_id, min(case when contains(upper(text), 'LABORATORY') and contains(upper(text), 'SAMPLE') then line_no end) as schedule_start,
  coalesce(min(case when contains(upper(text), 'APPENDIX') and contains(upper(text), 'LABORATORY') then line_no end), min(case when contains(text, 'CLINICAL LABORATORY TESTS') then line_no end)) as lab_start, max(line_no) + 1 as n from mapper_line group by doc_id),
rg as (select f.doc_id, schedule_start, (select min(line_no) from mapper_line m where m.doc_id = f.doc_id and line_no > schedule_start and (contains(upper(text), 'PHARMACOKINETICS') or contains(upper(text), 'PK SAMPLES'))) as schedule_end,
  lab_start, case when lab_start is not null then coalesce((select min(line_no) from mapper_line m where m.doc_id = f.doc_id and line_no > lab_start and regexp_matches(trim(text), {quote(S.LAB_STOP)}) and not contains(upper(text), 'LABORATORY') and not regexp_matches(text, '\\.{{4,}}')), n) end as lab_end from f)"""


@check("c11_detect_line_ranges", f"with {_RANGES} select * from rg", "mapper_line")
def _(t):
    return S.detect_line_ranges(t.mapper_line)


@check(
    "c12_appendix_block",
    """select o_orderkey as doc_id, case when o_orderkey % 3 = 2 then null else 'Appendix ' || (o_orderkey % 9) || ': Clinical Laboratory Tests' || chr(10) || 'Hemoglobin ' || o_custkey || case when o_orderkey % 3 = 0 then '' else chr(10) || 'Zinc' end end as lines from orders""",
)
def _(t):
    k, text = F.col("o_orderkey"), F.lit("Intro\n")
    text = F.concat(
        text,
        F.when(k % 3 == 2, "Appendix: none").otherwise(F.concat(F.lit("Appendix "), k % 9, F.lit(": C l i n i c a l Laboratory Tests"))),
        F.lit("\n CONFIDENTIAL\nHemoglobin "),
        F.col("o_custkey"),
        F.when(k % 3 == 0, "\nAppendix 3 next\nMore").otherwise("\n12\n Zinc "),
    )
    docs = repaired(t.orders.select(k.alias("doc_id"), text.alias("text")))
    return docs.select("doc_id", F.array_join(S.appendix_block(F.col("text")), "\n").alias("lines"))


@check(
    "c13_pipe_table_islands",
    "with i as (select doc_id, island as table_no, count(*) as n_lines from cell group by all) select * from i where n_lines >= 2",
    "cell",
)
def _(t):
    return S.pipe_table_islands(t.protocol_line)


_ROWS = rf"""r0 as (select doc_id, island as table_no, line_no, row_number() over (partition by doc_id, island order by line_no) as n, count(*) over (partition by doc_id, island) as cnt, trim(text) as text, {cells_("text")} as c from cell),
r1 as (select *, max(case when n = 1 then len(c) end) over (partition by doc_id, table_no) as w from r0 where cnt >= 2),
rows_ as (select doc_id, table_no, line_no, n = 1 as is_header, list_concat(c, list_transform(range(w), lambda i: ''))[1:w] as cells from r1 where not (n = 2 and regexp_matches(text, '^[| :\-]+$')) and (n = 1 or len(list_filter(c, lambda x: x <> '')) > 0))"""


@check(
    "c14_parse_pipe_table",
    f"with {_ROWS}, x as (select doc_id, table_no, line_no, is_header, cells, unnest(range(len(cells))) as col_no from rows_) select doc_id, table_no, line_no, is_header, col_no, cells[col_no + 1] as text from x",
    "cell",
)
def _(t):
    return S.pipe_cells(S.pipe_rows(t.protocol_line))


@check(
    "c15_find_table_by_header",
    f"with {_ROWS}, f as (select doc_id, min(table_no) as table_no from rows_ where is_header and contains(lower(cells[1]), 'code') group by doc_id) select r.doc_id, r.table_no, line_no, array_to_string(cells, ';') as row from rows_ r join f on r.doc_id = f.doc_id and r.table_no = f.table_no",
    "cell",
)
def _(t):
    found = S.find_table_by_header(S.pipe_rows(t.protocol_line), lambda h: F.lower(h).contains("code"))
    return found.select("doc_id", "table_no", "line_no", F.array_join("cells", ";").alias("row"))


def _best(kind: str) -> str:
    if kind == "soa":
        p = "case when list_any_value(list_filter(h, lambda x: contains(x, 'visit'))) is not null then 25 else 0 end + case when regexp_matches(h[1], 'procedure|assessment|test|laboratory') then 12 else 0 end + case when len(h) >= 4 then 8 else 0 end"
    else:
        p = "case when list_any_value(list_filter(h, lambda x: contains(x, 'clinical') and contains(x, 'lab'))) is not null then 25 else 0 end + case when regexp_matches(h[1], 'test|analyte|laboratory') then 12 else 0 end + case when list_any_value(list_filter(h, lambda x: contains(x, 'comment'))) is not null then 8 else 0 end"
    return f"""with {_ROWS}, hh as (select *, list_transform(cells, lambda x: lower(x)) as h from rows_),
    s as (select doc_id, table_no, count(*) filter (where not is_header) + max(case when is_header then {p} end) as score, count(*) filter (where not is_header) as n from hh group by doc_id, table_no),
    k as (select *, row_number() over (partition by doc_id order by score desc, table_no) as k from s where n > 0)
    select doc_id, table_no, score from k where k = 1"""


@check("c16_best_table_schedule", _best("soa"), "cell")
def _(t):
    return S.best_table(S.pipe_rows(t.protocol_line), "soa")


@check("c16_best_table_lab", _best("lab"), "cell")
def _(t):
    return S.best_table(S.pipe_rows(t.protocol_line), "lab")


@check(
    "c17_table_footnotes",
    r"""with f as (select doc_id, line_no, trim(text) as text, regexp_matches(trim(text), '^[\d*#]\s+') as k, regexp_matches(trim(text), '^[\d*#]\s+|^[a-z]') as g from protocol_line),
    p as (select *, last_value(case when not g then line_no end ignore nulls) over (partition by doc_id order by line_no) as br from f),
    n as (select *, min(case when k then line_no end) over (partition by doc_id, br order by line_no) as fm from p where g),
    ends as (select doc_id, island as table_no, max(line_no) as e from cell group by doc_id, island having count(*) >= 2),
    nx as (select ends.doc_id, table_no, min(f.line_no) as fm from ends join f on f.doc_id = ends.doc_id and f.line_no > e and f.k group by all)
    select nx.doc_id, nx.table_no, n.line_no, n.text from nx join n on nx.doc_id = n.doc_id and nx.fm = n.fm""",
    "cell",
)
def _(t):
    return S.table_footnotes(t.protocol_line)


@check(
    "c18_split_qa_pipe",
    "select o_orderkey as doc_id, 1 + l_linenumber * 8 as line_no, cast(l_linenumber as string) as q, s as sub_section, e as element, d as detail from qa where o_orderkey % 2 = 0",
    "qa",
)
def _(t):
    return S.split_qa_pipe(S.pipe_rows(t.question_line))


_OPENS = "'" + "|".join(QUESTION_SECTIONS) + "'"


@check(
    "c19_split_qa_lines",
    "select o_orderkey as doc_id, 1 + l_linenumber * 8 as line_no, cast(l_linenumber as string) as q, s as sub_section, e as element, d as detail from qa where o_orderkey % 2 = 1",
    "qa",
)
def _(t):
    return S.split_qa_lines(t.question_line)


@check("c19_question_rows", "select o_orderkey as doc_id, 1 + l_linenumber * 8 as line_no, cast(l_linenumber as string) as q, s as sub_section, e as element, d as detail from qa", "qa")
def _(t):
    return S.question_rows(t.question_line)


@check("c20_crop", "select doc_id, case when instr(lower(text), 'tion') > 0 then substring(text, instr(lower(text), 'tion'), 3000) else '' end as text from documents")
def _(t):
    return t.documents.select("doc_id", S.crop(F.col("text"), "tion", 3000).alias("text"))


@check(
    "c21_parse_two_col_text",
    r"""with r as (select doc_id, line_no, rtrim(text) as text from aligned_line where line_no > 40 and line_no < 60)
    select doc_id, line_no, trim(regexp_extract(text, '^(.*?)( {3,}|$)', 1)) as name, trim(case when regexp_matches(text, ' {3,}') then regexp_replace(text, '^.*? {3,}', '') else '' end) as comment from r where trim(text) <> ''""",
    "aligned_line",
)
def _(t):
    return S.parse_two_col_text(t.aligned_line)


@check(
    "c22_parse_aligned_matrix",
    r"""with r as (select doc_id, line_no, text, trim(substring(text, 1, 30)) as label, trim(substring(text, 46)) as comment from aligned_line
      where not regexp_matches(text, '(?i)^\s*(Visit\s+Number|Weeks?\s+from\s+Randomiz)') and not contains(text, 'Author and Content Review') and not contains(text, 'CONFIDENTIAL') and not regexp_matches(trim(text), '^\d*$')),
    k as (select *, row_number() over (partition by doc_id, label order by line_no) as k from r where label <> '' and line_no > 1),
    v as (select doc_id, line_no, label, text, comment, unnest([0, 1, 2]) as visit_ord from k where k = 1)
    select doc_id, line_no, label, visit_ord, cast(visit_ord + 1 as string) as visit, case when trim(substring(text, 31 + visit_ord * 7, 3)) = 'X' then 'X' else '' end as mark, comment from v""",
    "aligned_line",
)
def _(t):
    return S.parse_aligned_matrix(t.aligned_line)


@check(
    "c23_longest_matching_section",
    f"select doc_id, '9.1. Tumor Tissue Samples' as heading, {squeeze_('substring(text, 1, instr(text, chr(10) || ' + quote('9.2.') + ') - 1)')} as body from tissue",
    "tissue",
)
def _(t):
    return t.tissue.select("doc_id", S.longest_matching_section(F.col("text")).alias("s")).select("doc_id", "s.heading", "s.body")


@check(
    "c24_section_outline",
    f"""with {_SECT}, p as (select *, trim(replace(substring(text, 1, case when level = 1 then 60 else 50 end), chr(10), ' ')) as pv, case when level = 1 then '  ' else '    ' end || number || '. ' || title as en from full_sec)
    select doc_id, start_line, case when pv <> '' then en || ' — ' || pv || '...' else en end as entry from p""",
    "design_line",
)
def _(t):
    return S.section_outline(t.design_line)
