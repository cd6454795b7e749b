"""One query per operator over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import conversation_repair, decontaminate, html_text, importance_resampling, line_dedup, ngram_join, personal_data, quality
from studylake.llm import sentence_pieces, substring_dedup, token_files, twins, url_filter, vector_search
from studylake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return register


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_sentence_pieces")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


LINE_DEDUP_SQL = f"""
with lines as (
  select row_id, source, trim(l, ' ') as line, pos from (
    select row_number() over () as row_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
totals as (select source, count(*) as total from documents group by source),
seen as (select source, line, count(distinct row_id) as n from lines where line <> '' group by source, line),
bad as (select source, list(line) as lines from seen join totals using (source)
  where n >= {line_dedup.FLOOR} and n > {line_dedup.RATIO} * total group by source)
select doc_id, len(string_split(text, chr(10))) as n_lines,
  len(string_split(text, chr(10))) - len(kept) as n_dropped, sha256(array_to_string(kept, chr(10))) as text_sha256
from (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: not list_contains(coalesce(lines, []), trim(x, ' '))) as kept
  from documents left join bad using (source))
"""


@query("op5_line_dedup", LINE_DEDUP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("text_sha256"))


_WORDS = "string_split_regex(trim(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]+')"


def _shingles_sql(rel: str, key: str) -> str:
    words = f"select {key}, list_filter({_WORDS.format('text')}, lambda x: x <> '') as w from {rel}"
    return f"select {key}, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s, len(w) as n_words from ({words})"


DECONTAMINATE_SQL = f"""
with d as ({_shingles_sql("documents", "doc_id")}), i as ({_shingles_sql("benchmark", "item_id")}),
n as (select item_id, count(*) as n_item from i where n_words >= 5 group by item_id)
select doc_id, item_id, n_item, count(*) as n_found from d join i using (s) join n using (item_id)
group by doc_id, item_id, n_item having count(*) * 100 >= n_item * 80
"""


@query("op7_decontaminate", DECONTAMINATE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NGRAM_JOIN_SQL = f"""
with recursive s as ({_shingles_sql("documents", "doc_id")}),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where c * 100 >= (x.n + y.n - c) * 80),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, edges.b from reach join edges on reach.r = edges.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from documents d left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) m using (doc_id)
"""


@query("op8_ngram_join", NGRAM_JOIN_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


URL_RULES = """
select * from values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
 ('net', '/es/', 'block'), ('net', '/fr/', 'block') as rules(host, path, verdict)
"""
URL_FILTER_SQL = """
with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest as (select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)
select page_id, any_value(host) as host, any_value(path) as path, max_by(h || p, length(h || p)) as rule, coalesce(max_by(v, length(h || p)), 'allow') as verdict
from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
"""


@query("op9_url_filter", URL_FILTER_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), spark.sql(URL_RULES))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_back(files, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_vector_search")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.nearest(rows, rows.filter("vec_id % 20 = 0"))


@query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", twins.REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


@query("op12_importance_resampling", twins.RESAMPLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_substring_dedup", twins.WORDS_50_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = substring_dedup.drop_repeated(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
