"""Text normalisation."""

from pyspark.sql import functions as F

from studylake.checks.registry import check
from studylake.checks.sqltext import clip_, html_text_, squeeze_, strip_
from studylake.functions import text as X

_HTML = html_text_("html")


@check("b1_html_to_text", f"select page_id, {_HTML} as text from pages")
def _(t):
    return t.pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@check(
    "b2_looks_like_html",
    f"""with d as (select 'p' as kind, page_id as id, html as body from pages union all select 'd', doc_id, text from documents)
    select kind, id, regexp_matches(lower(substring(ltrim(body, ' ' || chr(9) || chr(10) || chr(13)), 1, 512)), '<html|<body|<table|<\\w+[^>]*>') as is_html from d""",
)
def _(t):
    docs = t.pages.select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(
        t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    )
    return docs.select("kind", "id", X.looks_like_html(F.col("body")).alias("is_html"))


_TABLES = f"""
with tabs as (select doc_id, unnest(list_transform(t, lambda x, i: {{'n': i, 'b': x}})) as u from (select doc_id, regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1) as t from html_table)),
trs as (select doc_id, u.n as tn, unnest(list_transform(r, lambda x, i: {{'n': i, 'b': x}})) as v from (select doc_id, u, regexp_extract_all(u.b, '(?is)<tr[^>]*>(.*?)</tr>', 1) as r from tabs)),
tds as (select doc_id, tn, v.n as rn, regexp_extract_all(v.b, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1) as c from trs),
kept as (select *, row_number() over (partition by doc_id, tn order by rn) - 1 as row_no, count(*) over (partition by doc_id, tn) as n, max(len(c)) over (partition by doc_id, tn) as w from tds where len(c) > 0),
named as (select *, dense_rank() over (partition by doc_id order by tn) - 1 as table_no from kept where n >= 2),
wide as (select doc_id, table_no, row_no, c, unnest(range(w)) as col_no from named)
select doc_id, table_no, row_no, col_no, coalesce({squeeze_(html_text_("c[col_no + 1]"))}, '') as text from wide
"""


@check("b3_html_tables", _TABLES, "html_table")
def _(t):
    return X.html_tables(t.html_table, "doc_id", "html")


@check(
    "b4_normalize_content",
    f"""select kind, doc_id, case when kind = 'd' then content when kind = 'p' then {html_text_("content")}
      when content like '{{bad%' then content
      else json_extract_string(content, '$.text') || chr(10) || chr(10) || json_extract_string(content, '$.k.note') end as text
    from (select kind, doc_id, content from content where kind <> 'e' or content not like '{{bad%'
          union all select kind, doc_id, content from content where kind = 'e' and content like '{{bad%') c""",
    "content",
)
def _(t):
    return X.normalize_content(t.content, "format", "content").select("kind", "doc_id", "text")


@check(
    "b5_flatten_json_text",
    """select event_id as doc_id, event_type || chr(10) || chr(10) || 'page ' || user_id || chr(10) || chr(10) || 'plain' || chr(10) || chr(10)
      || 'last ' || event_type || chr(10) || chr(10) || 'inner ' || (event_id % 9) as text from events""",
)
def _(t):
    return X.flatten_json_text(t.json_doc, "json").select("doc_id", "text")


@check(
    "b6_strip_json_suffix",
    """with w as (select *, lead(text) over v as n1, lead(text, 2) over v as n2, max(line_no) over (partition by doc_id) as last from protocol_line window v as (partition by doc_id order by line_no)),
    c as (select *, max(case when trim(text) = '{' and line_no > 5 and (contains(text, '"pages"') or contains(n1, '"pages"') or contains(n2, '"pages"')) then line_no end) over (partition by doc_id) as cut from w)
    select doc_id, line_no, text from c where cut is null or line_no < cut""",
    "protocol_line",
)
def _(t):
    return X.strip_json_suffix(t.protocol_line)


@check(
    "b7_normalize_ws",
    f"""select doc_id, {strip_("regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as text from documents""",
)
def _(t):
    return t.documents.select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@check(
    "b8_repair_spaced_text",
    r"""with s as (select o_orderkey as doc_id, o_orderkey % 3 as m, cast(o_orderkey as string) as k from orders)
    select doc_id, case m when 0 then 'IDH8X-MC-AB' || k || ' seen' when 1 then 'The summary of a b c here' else 'Plain A B-text ' || k end as text from s
    where m <> 2 union all select doc_id, 'Plain AB-text ' || k from s where m = 2 and false
    union all select doc_id, 'Plain AB-Text ' || k from s where m = 2""",
)
def _(t):
    key, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (
        F.when(key % 3 == 0, F.concat(F.lit("ID H 8 X-MC-A B"), k, F.lit(" seen")))
        .when(key % 3 == 1, F.lit("The s u m m a r y of a b c here"))
        .otherwise(F.concat(F.lit("Plain A B-Text "), k))
    )
    return t.orders.select(key.alias("doc_id"), X.repair_spaced_text(raw).alias("text"))


@check("b9_strip_control", "select doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') as text from documents")
def _(t):
    return t.documents.select("doc_id", X.strip_control(F.col("text")).alias("text"))


@check("b10_clip", f"select doc_id, {clip_('text', 300)} as text from documents")
def _(t):
    return t.documents.select("doc_id", X.clip(F.col("text"), 300).alias("text"))


@check(
    "b11_first_sentence",
    f"""with s as (select doc_id, {squeeze_('text')} as s from documents)
    select doc_id, case when instr(s, '. ') between 1 and 150 then trim(substring(s, 1, instr(s, '. '))) else {clip_('s', 150)} end as text from s""",
)
def _(t):
    return t.documents.select("doc_id", X.first_sentence(F.col("text"), 150).alias("text"))


@check(
    "b12_drop_page_noise",
    """select doc_id, line_no, text from protocol_line where not regexp_matches(trim(text), '(?i)^(?:#\\s*)?(?:CONFIDENTIAL|Approved\\s+on|---\\s*PAGE\\s+\\d+|Page\\s+\\d+\\s+of\\s+\\d+)')
    and not regexp_matches(text, '^\\s*Author and Content Review|CONFIDENTIAL|^\\s*\\d{1,3}\\s*$|^Commented\\s*\\[')""",
    "protocol_line",
)
def _(t):
    return X.drop_page_noise(t.protocol_line)


@check(
    "b13_normalize_bbox",
    """select doc_id, page, greatest(0.0, least(1000.0, (x0 / width) * 1000)) as left_edge, greatest(0.0, least(1000.0, ((height - y1) / height) * 1000)) as top_edge,
      greatest(0.0, least(1000.0, (x1 / width) * 1000)) as right_edge, greatest(0.0, least(1000.0, ((height - y0) / height) * 1000)) as bottom_edge
    from (select doc_id, page, x0, y0, x1, y1, cast(width as double) as width, cast(height as double) as height from bbox) b""",
    "bbox",
)
def _(t):
    b = t.bbox.select("doc_id", "page", "x0", "y0", "x1", "y1", F.col("width").cast("double"), F.col("height").cast("double"))
    box = X.normalize_bbox(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height")])
    b = b.select("doc_id", "page", box.alias("b"))
    names = ("left_edge", "top_edge", "right_edge", "bottom_edge")
    return b.select("doc_id", "page", *[F.col("b")[i].alias(n) for i, n in enumerate(names)])


@check("b14_clean_header", f"select p_partkey, {squeeze_(chr(39) + chr(39) + ' || replace(p_brand || chr(10) || p_type, chr(42), chr(32))')} as header from part")
def _(t):
    raw = F.concat(F.lit(" *"), F.replace("p_brand", F.lit("*"), F.lit(" ")), F.lit("\n* "), F.col("p_type"), F.lit("*"))
    return t.part.select("p_partkey", X.clean_header(raw).alias("header"))


@check(
    "b15_tags",
    """with s as (select p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ' , '), ','), lambda x: trim(x)), lambda x: x <> '') as tags, p_brand from part),
    a as (select p_partkey, case when list_contains(tags, trim(p_brand)) then tags else list_append(tags, trim(p_brand)) end as tags from s)
    select p_partkey, array_to_string(list_filter(tags, lambda x: x <> 'STEEL'), ', ') as tags, len(tags) as n from a""",
)
def _(t):
    tags = X.to_tags(F.replace("p_type", F.lit(" "), F.lit(" , ")))
    more = X.add_tag(tags, F.col("p_brand"))
    return t.part.select("p_partkey", X.from_tags(X.remove_tag(more, "STEEL")).alias("tags"), F.size(more).alias("n"))


@check("b16_pages_with_tables", "select distinct doc_id, page from page_block where html is not null", "page_block")
def _(t):
    from studylake.sources.readers import pages_with_tables, to_pages

    return pages_with_tables(to_pages(t.page_block)).select("doc_id", "page")
