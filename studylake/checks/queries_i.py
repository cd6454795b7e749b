"""Forms and specimen columns."""

from pyspark.sql import functions as F

from studylake.checks.registry import check
from studylake.checks.sqltext import squeeze_
from studylake.operators import forms as I

_M = "o_orderkey % 4 in (0, 2)"
_VALS = f"""vals as (select o_orderkey as file_id, {_M} as c, o_orderkey % 4 as m4,
 case o_orderkey % 4 when 0 then 'clips' when 1 then 'non_pkpd' when 2 then 'clips' else null end as form_type,
 case when {_M} then 'AN' || o_custkey else 'ignored' end as analyte, case o_orderkey % 5 when 0 then 'ADA (Anti-drug antibody)' when 1 then 'Specimen Type' else 'ELISA' end as assay_type,
 case o_orderkey % 6 when 0 then 'DNA' when 1 then 'Serum' when 2 then 'Plasma' when 3 then 'RNA' else 'Hair' end as specimen_type, case o_orderkey % 3 when 0 then 'true' when 1 then 'No' else 'pending' end as validation,
 case when o_orderkey % 4 <> 3 then 'Lab ' || o_orderpriority end as assay_lab, case when o_orderkey % 3 <> 0 then 'EDTA' end as tube, (o_orderkey % 10) || ' ml' as size, o_orderpriority as contact_name,
 case when o_orderkey % 2 = 0 or o_orderkey % 5 = 1 then cast(o_orderkey % 300 as varchar) end as dur, case when not {_M} then '14' end as refr from orders)"""


@check(
    "i1_form_label_value",
    f"""with {_VALS}, l as (select file_id, case when c then 'Analyte(s) for Measurement' else 'Test name' end as label, 1 as row_no, analyte as value from vals union all select file_id, 'Assay Type', 2, assay_type from vals
    union all select file_id, 'Specimen Type', 2, specimen_type from vals union all select file_id, 'Validation Complete', 3, validation from vals union all select file_id, case when c then 'Bioanalytical Lab Name' else 'Reference Laboratory Name' end, 4, assay_lab from vals
    union all select file_id, case when c then 'Type of tube' else 'Specimen Subtype' end, 5, tube from vals union all select file_id, case when c then 'Tube size' else 'Address' end, 6, size from vals
    union all select file_id, case when c then 'days at -20°C' else 'AMB' end, 7, dur from vals union all select file_id, 'REFR', 8, refr from vals union all select file_id, case when c then 'Contact Name' else 'Laboratory Contact' end, 9, contact_name from vals)
    select * from l where value is not null""",
)
def _(t):
    return I.form_label_value(t.form_cell)


@check("i2_detect_form_type", f"with {_VALS} select file_id, form_type from vals")
def _(t):
    return I.detect_form_type(t.form_cell, I.form_label_value(t.form_cell))


_DUR = "case when c then dur || ' days at -20°C' when form_type is not null then nullif(concat_ws('; ', 'AMB: ' || dur, 'REFR: ' || refr), '') end"


@check("i3_storage_text", f"with {_VALS} select file_id, {_DUR} as storage_duration from vals")
def _(t):
    return I.form_record(t.form_cell).select("file_id", "storage_duration")


@check("i4_yes_no_passthrough", "select alias, case when lower(trim(pediatric_raw)) in ('y', 'yes', 'true') then 'Yes' when lower(trim(pediatric_raw)) in ('n', 'no', 'false') then 'No' else trim(pediatric_raw) end as answer from study", "study")
def _(t):
    return t.study.select("alias", I.yes_no_passthrough(F.col("pediatric_raw")).alias("answer"))


_REC = f"""{_VALS}, rec as (select file_id, form_type, form_type as effective_type, analyte, case when c then specimen_type || coalesce(' - ' || tube, '') else analyte end as analyte_name_value, specimen_type || coalesce(' - ' || tube, '') as sample_type_value,
 specimen_type, assay_type, case validation when 'true' then 'Yes' else validation end as validated_assay, assay_lab, case when not c then size end as assay_lab_location, contact_name, tube as special_tube, case when c then size end as tube_size, {_DUR} as storage_duration from vals)"""


@check("i5_form_record", f"with {_REC} select * from rec")
def _(t):
    return I.form_record(t.form_cell).drop("proprietary_assay", "special_tube_required")


_COL = "case when form_type = 'clips' then 'LTS PK' when form_type is null then null when assay_type like 'ADA%' then 'LTS Immunogenicity' when specimen_type <> 'Hair' then 'LTS ' || specimen_type end"


@check("i6_assign_column", f"with {_REC} select file_id, {_COL} as base_label from rec")
def _(t):
    return I.assign_column(I.form_record(t.form_cell)).select("file_id", "base_label")


@check("i7_unmapped_files", f"with {_REC} select file_id from rec where {_COL} is null")
def _(t):
    return I.unmapped_files(I.assign_column(I.form_record(t.form_cell)))


_REG = f"""reg as (select file_id, role || ':' || col_no as column_key, role, col_no as col_index, base_label, base_label || case when n > 1 then ' (' || i || ')' else '' end || case when role = 'referral' then ' (referral)' else ' (LTS)' end as display_label, case when role = 'referral' then 'referral' else 'lts' end as tag
 from (select *, count(*) over (partition by file_id, role, base_label) as n, row_number() over (partition by file_id, role, base_label order by col_no) as i from (select *, {squeeze_("replace(text, '*', '')")} as base_label from specimen_cell where row_no = 0 and col_no > 0) a) b)"""


@check("i8_column_registry", f"with {_REG} select * from reg", "specimen_cell")
def _(t):
    return I.column_registry(t.specimen_cell.where("row_no = 0"))


_FILES = "select file_id, case when file_id % 2 = 0 then 'referral' else 'storage_wide' end as role from rec"


@check(
    "i9_row_values",
    f"""with {_REC}, f as (select rec.*, case when file_id % 2 = 0 then 'referral' else 'storage_wide' end as role from rec), u as (
    select file_id, role, 'Post-LPV storage' as row_label, '7' as value from f union all select file_id, role, '# post-LPV storage aliquots', 'all aliquots' from f union all select file_id, role, 'Analyte name', analyte_name_value from f
    union all select file_id, role, 'Sample type', sample_type_value from f union all select file_id, role, 'Sample vol / collection', tube_size from f union all select file_id, role, '# aliquots/expected sample', case when effective_type = 'clips' then '1' end from f
    union all select file_id, role, 'Validated assay', validated_assay from f where role = 'referral' union all select file_id, role, 'Ref Lab contract owner', contact_name from f where role = 'referral' union all select file_id, role, 'Assay lab', assay_lab from f where role = 'referral'
    union all select file_id, role, 'Assay lab city, state, country', assay_lab_location from f where role = 'referral' union all select file_id, role, 'Special collection tube required?', 'Yes' from f where role = 'referral' union all select file_id, role, 'Special collection tube', special_tube from f where role = 'referral'
    union all select file_id, role, '# of results per expected sample', '1' from f where role = 'referral') select * from u where value is not null""",
)
def _(t):
    records = I.form_record(t.form_cell).withColumn("role", F.when(F.col("file_id") % 2 == 0, "referral").otherwise("storage_wide"))
    return I.row_values(records)


def _registry(t):
    """The template's columns: those of one specimen file, which are all alike."""
    reg = I.column_registry(t.specimen_cell.where("row_no = 0"))
    return reg.groupBy("column_key", "role", "col_index", "base_label").agg(F.count("*").alias("n")).drop("n")


_PLAN = f"""{_REG}, tpl as (select distinct column_key, role, col_index, base_label from reg),
asg as (select a.doc_id, file_id, file_ord, t.*, row_number() over (partition by a.doc_id, a.column_key order by file_ord) as i, count(*) over (partition by a.doc_id, a.column_key) as n from assignment a join tpl t on a.column_key = t.column_key),
us as (select doc_id, role, column_key, max(col_index) as ci, max(n) - 1 as more from asg group by all),
sh as (select *, coalesce(sum(more) over (partition by doc_id, role order by ci rows between unbounded preceding and 1 preceding), 0) as shift from us),
pl as (select a.doc_id, a.file_id, a.role, cast(a.col_index + shift + i - 1 as bigint) as col_index, base_label || case when n > 1 then ' (' || i || ')' else '' end as header, i > 1 as inserted from asg a join sh on a.doc_id = sh.doc_id and a.column_key = sh.column_key)"""


@check("i10_plan_column_inserts", f"with {_PLAN} select * from pl", "specimen_cell", "assignment")
def _(t):
    return I.plan_column_inserts(t.assignment.where("column_key is not null"), _registry(t))


@check(
    "i11_shared_rows",
    f"with {_PLAN}, d as (select distinct doc_id, role from pl) select doc_id, role, unnest(['{I.SHARED_ROWS[0]}', '{I.SHARED_ROWS[1]}', '{I.SHARED_ROWS[2]}']) as row_label, 'frozen' as value from d",
    "specimen_cell", "assignment",
)
def _(t):
    return I.shared_rows(I.plan_column_inserts(t.assignment.where("column_key is not null"), _registry(t)))


_TPL = "tpl as (select 'referral:1' as column_key, 'referral' as role, 1 as col_index, 'LTS PK' as base_label union all select 'referral:2', 'referral', 2, 'Limited use bmkr' union all select 'referral:4', 'referral', 4, 'LTS Immunogenicity' union all select 'storage_wide:2', 'storage_wide', 2, 'LTS Serum' union all select 'storage_wide:9', 'storage_wide', 9, 'LTS Serum')"


def _template(t):
    """The template's columns, one of them repeated, one unknown to the files."""
    reg = _registry(t).where("column_key in ('referral:1', 'referral:2', 'referral:4', 'storage_wide:2')")
    more = reg.where("column_key = 'storage_wide:2'").select(F.lit("storage_wide:9").alias("column_key"), "role", F.lit(9).alias("col_index"), "base_label")
    return reg.unionByName(more)


_MATCH = f"""{_TPL}, rk as (select *, row_number() over (partition by role, base_label order by col_index) as k from tpl),
hm as (select file_id, h.role, col_no, b.base_label, row_number() over (partition by file_id, h.role, b.base_label order by col_no) as k from (select * from specimen_cell where row_no = 0 and col_no > 0) h join (select distinct role, base_label from tpl) b on h.role = b.role and contains(lower(text), lower(b.base_label))),
mt as (select file_id, column_key, col_no as col_index from rk join hm on rk.role = hm.role and rk.base_label = hm.base_label and rk.k = hm.k)"""


def _matched(t):
    return I.match_columns(_template(t), t.specimen_cell.where("row_no = 0"))


@check("i12_match_columns", f"with {_MATCH} select * from mt", "specimen_cell")
def _(t):
    return _matched(t)


_PH = "(trim(text) = '' or lower(trim(text)) in ('na', 'select', '#', '# yr or na', 'x ml or # fta cards') or lower(trim(text)) like 'list %' or lower(trim(text)) like 'x ml%' or regexp_matches(trim(text), '(?i)^\\d+\\s*\\(default\\)$'))"


@check("i13_is_placeholder", f"select file_id, role, row_no, col_no, {_PH} as placeholder from specimen_cell where row_no > 0 and col_no > 0", "specimen_cell")
def _(t):
    body = t.specimen_cell.where("row_no > 0 and col_no > 0")
    return body.select("file_id", "role", "row_no", "col_no", I.is_placeholder(F.col("text")).alias("placeholder"))


_PREV = f"""{_MATCH}, body as (select *, max(case when col_no = 0 then trim(text) end) over (partition by file_id, role, row_no) as row_label from specimen_cell where row_no > 0),
pr as (select s.file_id, s.role, row_label, column_key, trim(s.text) as value, {_PH.replace('text', 's.text')} as ph from body s join mt on s.file_id = mt.file_id and s.role = split_part(column_key, ':', 1) and s.col_no = mt.col_index where trim(s.text) <> '' and row_label <> ''),
pc as (select mt.file_id, mt.column_key, coalesce(bool_or(not ph), false) as has_data from mt left join pr on mt.file_id = pr.file_id and mt.column_key = pr.column_key group by all)"""


@check("i14_previous_rows", f"with {_PREV} select file_id, role, row_label, column_key, value from pr", "specimen_cell")
def _(t):
    return I.previous_rows(t.specimen_cell, _matched(t))


def _columns(t):
    m = _matched(t)
    return I.previous_columns(I.previous_rows(t.specimen_cell, m), m)


@check("i14_previous_columns", f"with {_PREV} select * from pc", "specimen_cell")
def _(t):
    return _columns(t)


@check("i15_default_selection", f"with {_PREV} select file_id, column_key from pc where has_data", "specimen_cell")
def _(t):
    return I.default_selection(_columns(t))


@check(
    "i16_apply_selection",
    f"""with {_PREV}, a as (select mt.*, has_data, coalesce(sum(case when has_data then 0 else 1 end) over (partition by mt.file_id, split_part(mt.column_key, ':', 1) order by col_index rows between unbounded preceding and 1 preceding), 0) as gone from mt join pc on mt.file_id = pc.file_id and mt.column_key = pc.column_key)
    select file_id, column_key, cast(col_index - gone as int) as col_index from a where has_data""",
    "specimen_cell",
)
def _(t):
    return I.apply_selection(_matched(t), I.default_selection(_columns(t)))


@check(
    "i17_prefix_label_join",
    """with e as (select l_orderkey as file_id, substring(p_name, 1, 1 + l_linenumber % 9) as key, min(l_shipmode) as value from li group by all), b as (select distinct l.l_orderkey as file_id, l.p_name as row_label, e.key, e.value, row_number() over (partition by l.l_orderkey, l.p_name order by length(e.key) desc, e.key desc) as k from (select distinct l_orderkey, p_name from li) l join e on e.file_id = l.l_orderkey and starts_with(l.p_name, e.key))
    select file_id, row_label, key, value from b where k = 1""",
    "li",
)
def _(t):
    labels = t.li.select(F.col("l_orderkey").alias("file_id"), F.col("p_name").alias("row_label"))
    key = F.substring(F.col("p_name"), F.lit(1), 1 + F.col("l_linenumber") % 9)
    entries = t.li.groupBy(F.col("l_orderkey").alias("file_id"), key.alias("key")).agg(F.min("l_shipmode").alias("value"))
    return I.prefix_label_join(labels, entries)


_META = "meta as (select l_orderkey as file_id, l_linenumber as table_no, case l_partkey % 3 when 0 then 'Referral Lab samples' when 1 then 'Storage samples' else 'Other' end as title, cast(l_suppkey % 12 + 1 as int) as n_rows, cast(l_partkey % 5 + 1 as int) as n_cols from item)"


@check(
    "i18_locate_table",
    f"""with {_META}, f as (select *, row_number() over (partition by file_id order by n_rows desc, n_cols desc, table_no) as k from meta where contains(lower(title), 'referral lab') and n_rows >= 2)
    select f.file_id, case when f.n_rows < 4 and n.table_no is not null then n.table_no else f.table_no end as table_no from f left join meta n on n.file_id = f.file_id and n.table_no = f.table_no + 1 where k = 1""",
    "item",
)
def _(t):
    p = F.col("l_partkey") % 3
    meta = t.item.select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").alias("table_no"),
        F.when(p == 0, "Referral Lab samples").when(p == 1, "Storage samples").otherwise("Other").alias("title"),
        (F.col("l_suppkey") % 12 + 1).cast("int").alias("n_rows"),
        (F.col("l_partkey") % 5 + 1).cast("int").alias("n_cols"),
    )
    return I.locate_table(meta, "REFERRAL LAB", min_rows=2)


@check(
    "i19_single_source",
    "with e as (select l_orderkey as doc_id, case when l_returnflag = 'R' then 0 else 1 end as source_rank, l_linenumber as row_no from item), m as (select doc_id, min(source_rank) as r from e group by doc_id) select e.* from e join m on e.doc_id = m.doc_id and source_rank = r",
    "item",
)
def _(t):
    rank = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    return I.single_source(t.item.select(F.col("l_orderkey").alias("doc_id"), rank.alias("source_rank"), F.col("l_linenumber").alias("row_no")))


@check(
    "i20_apply_manual_columns",
    f"""with {_REC}, au as (select file_id, {_COL} as base_label from rec) select file_id, case when file_id % 5 = 0 then 'storage_wide:3' when base_label = 'LTS PK' then 'referral:1' when base_label = 'LTS Immunogenicity' then 'referral:4' when base_label = 'LTS DNA' then 'storage_wide:1' when base_label = 'LTS Serum' then 'storage_wide:2' when base_label = 'LTS Plasma' then 'storage_wide:3' end as column_key,
    case when file_id % 5 = 0 then 'manual' when base_label is null or base_label = 'LTS RNA' then 'open' else 'auto' end as source from au""",
)
def _(t):
    assigned = I.assign_column(I.form_record(t.form_cell))
    manual = assigned.where("file_id % 5 = 0").select("file_id", F.lit("storage_wide:3").alias("column_key"))
    return I.apply_manual_columns(assigned.select("file_id"), assigned, _registry(t), manual)
