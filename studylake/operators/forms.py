"""Laboratory forms and the specimen columns their values go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.sequence import carry
from studylake.functions.text import clean_header, let, strip
from studylake.operators.schedule import choose_source
from studylake.operators.studies import yes_no

# Field labels of the two form types, in the order they are tried.
CLINICAL, WORKSHEET = "clips", "non_pkpd"
LABELS = {
    CLINICAL: {
        "analyte": ["Analyte(s) for Measurement"],
        "specimen_type": ["Specimen Type"],
        "assay_type": ["Assay Type"],
        "validation": ["Validation Complete"],
        "assay_lab": ["Bioanalytical Lab Name"],
        "address": ["Address Line 1"],
        "city": ["City, State  Zip Code", "City, State Zip Code"],
        "contact_name": ["Contact Name"],
        "training": ["Is special training required for personnel processing the samples?"],
        "tube": ["Type of tube"],
        "tube_size": ["Tube size"],
    },
    WORKSHEET: {
        "analyte": ["Test name"],
        "specimen_type": ["Specimen Type"],
        "assay_type": ["Assay Type"],
        "validation": ["Validation Complete"],
        "assay_lab": ["Reference Laboratory Name"],
        "address": ["Address"],
        "contact_name": ["Laboratory Contact"],
        "training": ["Special Training Required?"],
        "tube": ["Specimen Subtype"],
    },
}
# Labels of storage durations; the first two vary in their special characters.
FROZEN = {
    "days at -20°C": r"(?i)Long.?term at.{1,3}20.{1,3}C \(days\)",
    "days at -70°C": r"(?i)Long.?term at.{1,3}70.{1,3}C \(days\)",
}
DURATIONS = ["AMB", "REFR", "FRZ -10 or colder", "FRZ -60 or colder", "Other FRZ"]
# The label of this field names the sponsor, which differs from form to form.
PROPRIETARY = r"(?i)^\S+-developed or \S+-assay transfer$"
TITLES = {
    WORKSHEET: "non-pk data mgmt|non-pk data management",
    CLINICAL: "specimen collection, processing and shipping|clinical processing instructions",
}
ANTIBODY = r"(?i)\bADA\b|\bNAb\b|anti[- ]?drug antibody|neutralizing antibody"
SPECIMEN_COLUMNS = {"dna": "LTS DNA", "serum": "LTS Serum", "plasma": "LTS Plasma", "rna": "LTS RNA"}
SHARED_ROWS = (
    "Ship site to central lab",
    "Ship central lab to referral lab for testing",
    "Ship central lab to central lab biorepository for storage",
)
PLACEHOLDERS = ("na", "select", "#", "# yr or na", "x ml or # fta cards")


def first_line(cell: Column) -> Column:
    return strip(F.substring_index(F.coalesce(cell, F.lit("")), "\n", 1))


def label_of(cell: Column) -> Column:
    """Name of the known label a cell's first line is; null for other cells."""
    exact = {label for form in LABELS.values() for labels in form.values() for label in labels} | set(DURATIONS)
    names = F.create_map(*[F.lit(x) for label in sorted(exact) for x in (label.lower(), label)])
    patterned = [("proprietary", PROPRIETARY), *FROZEN.items()]
    return let(
        first_line(cell),
        lambda line: F.coalesce(
            F.try_element_at(names, F.lower(line)), *[F.when(line.rlike(p), F.lit(name)) for name, p in patterned]
        ),
    )


def form_label_value(cells: DataFrame) -> DataFrame:
    """``(file_id, label, row_no, value)`` for every known label of a form.

    A value is the second line of the label's own cell, else the next filled cell of the row
    that is not the label again. The first row with a value counts. Rows are short, so each is
    read as an array; labels are looked up cell by cell, without a join.
    """
    rows = cells.groupBy("file_id", "row_no").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("col_no", "text", label_of(F.col("text")).alias("label")))),
            lambda c: F.struct(c["text"].alias("text"), c["label"].alias("label")),
        ).alias("c")
    )
    marked = rows.select("file_id", "row_no", "c", F.posexplode("c").alias("i", "cell")).where("cell.label is not null")
    text, label = F.col("cell.text"), F.col("cell.label")
    own = strip(F.substring_index(strip(F.regexp_replace(text, r"^[^\n]*\n", "")), "\n", 1))
    inner = F.when(text.contains("\n"), F.nullif(own, F.lit("")))
    later = F.filter(
        F.slice("c", F.col("i") + 2, F.size("c")),
        lambda o: o["text"].isNotNull() & (strip(o["text"]) != "") & ~o["label"].eqNullSafe(label),
    )
    value = F.coalesce(inner, strip(F.try_element_at(later, F.lit(1))["text"]))
    hits = marked.select("file_id", "row_no", "i", label.alias("label"), value.alias("value")).where("value is not null")
    return hits.groupBy("file_id", "label").agg(
        F.min("row_no").alias("row_no"), F.min_by("value", F.struct("row_no", "i")).alias("value")
    )


def detect_form_type(cells: DataFrame, values: DataFrame) -> DataFrame:
    """``(file_id, form_type)``: by title words in the first six rows, else by a label that only
    one form has; null if neither tells."""
    head = cells.groupBy("file_id").agg(
        *[F.bool_or((F.col("row_no") < 6) & F.lower(first_line(F.col("text"))).rlike(words)).alias(f"_{k}") for k, words in TITLES.items()]
    )
    only = values.where(F.col("label").isin("Bioanalytical Lab Name", "Reference Laboratory Name")).groupBy("file_id").agg(
        F.bool_or(F.col("label") == "Bioanalytical Lab Name").alias("_c"), F.bool_or(F.col("label") == "Reference Laboratory Name").alias("_w")
    )
    kind = (
        F.when(F.col(f"_{WORKSHEET}"), WORKSHEET)
        .when(F.col(f"_{CLINICAL}"), CLINICAL)
        .when(F.col("_c"), CLINICAL)
        .when(F.col("_w"), WORKSHEET)
    )
    return head.join(only, "file_id", "left").select("file_id", kind.alias("form_type"))


def yes_no_passthrough(raw: Column) -> Column:
    """Yes/No where the word says so, else the word itself; digits are no answer here."""
    word = strip(raw)
    return F.when(word.isin("0", "1"), word).otherwise(F.coalesce(yes_no(word), word))


def form_record(cells: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row per file: type, effective type (a hint serves only where the type is unknown) and
    fields. Works on one small row of label values per file."""
    values = form_label_value(cells)
    types = detect_form_type(cells, values)
    wide = values.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("v"))
    base = types.join(wide, "file_id", "left")
    if hints is not None:
        base = base.join(hints.select("file_id", "hint"), "file_id", "left")
    else:
        base = base.withColumn("hint", F.lit(None).cast("string"))
    base = base.withColumn("effective_type", F.coalesce("form_type", "hint"))
    clinical = F.coalesce(F.col("effective_type") == CLINICAL, F.lit(False))

    def get(field: str) -> Column:
        pick = lambda form: F.coalesce(*[F.try_element_at("v", F.lit(x)) for x in LABELS[form].get(field, [])], F.lit(None).cast("string"))
        return F.when(clinical, pick(CLINICAL)).otherwise(pick(WORKSHEET))

    raw = base.select(
        "file_id",
        "form_type",
        "effective_type",
        clinical.alias("_clinical"),
        *[get(f).alias(f) for f in LABELS[CLINICAL]],
        F.try_element_at("v", F.lit("proprietary")).alias("_own"),
        storage_text(F.col("v"), F.col("effective_type")).alias("storage_duration"),
    )
    paired = lambda a: F.when(a.isNotNull() & F.col("tube").isNotNull(), F.concat_ws(" - ", a, "tube")).otherwise(a)
    sample = paired(F.col("specimen_type"))
    return raw.select(
        "file_id",
        "form_type",
        "effective_type",
        "analyte",
        F.when(F.col("_clinical"), sample).otherwise(F.col("analyte")).alias("analyte_name_value"),
        sample.alias("sample_type_value"),
        "specimen_type",
        "assay_type",
        yes_no_passthrough(F.col("validation")).alias("validated_assay"),
        F.when(~F.col("_clinical"), F.col("_own")).alias("proprietary_assay"),
        "assay_lab",
        F.when(F.col("_clinical"), F.nullif(F.concat_ws(", ", "address", "city"), F.lit(""))).otherwise(F.col("address")).alias("assay_lab_location"),
        "contact_name",
        yes_no_passthrough(F.col("training")).alias("special_tube_required"),
        F.col("tube").alias("special_tube"),
        F.when(F.col("_clinical"), F.col("tube_size")).alias("tube_size"),
        "storage_duration",
    )


def storage_text(values: Column, form_type: Column) -> Column:
    """Storage durations of a form as one text; null without any."""
    get = lambda k: F.try_element_at(values, F.lit(k))
    cold = F.concat_ws("; ", *[F.when(get(s).isNotNull(), F.concat(get(s), F.lit(f" {s}"))) for s in FROZEN])
    listed = F.concat_ws("; ", *[F.when(get(d).isNotNull(), F.concat(F.lit(f"{d}: "), get(d))) for d in DURATIONS])
    return F.when(form_type == CLINICAL, F.nullif(cold, F.lit(""))).when(form_type.isNotNull(), F.nullif(listed, F.lit("")))


def assign_column(records: DataFrame) -> DataFrame:
    """Adds ``base_label``, the specimen column a form belongs to; null if it cannot be told."""
    antibody = F.coalesce(F.col("assay_type").rlike(ANTIBODY), F.lit(False)) | F.coalesce(F.col("analyte").rlike(ANTIBODY), F.lit(False))
    columns = F.create_map(*[F.lit(x) for kv in SPECIMEN_COLUMNS.items() for x in kv])
    label = (
        F.when(F.col("form_type") == CLINICAL, "LTS PK")
        .when((F.col("form_type") == WORKSHEET) & antibody, "LTS Immunogenicity")
        .when(F.col("form_type") == WORKSHEET, F.try_element_at(columns, F.lower(strip(F.col("specimen_type")))))
    )
    return records.withColumn("base_label", label)


def unmapped_files(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("base_label").isNull()).select("file_id")


# --- specimen tables ----------------------------------------------------------------------------------


def column_registry(heads: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """``(key…, column_key, role, col_index, base_label, display_label, tag)`` from header cells;
    repeated labels of a table are numbered from the left. A table's header is a few cells."""
    labelled = heads.where("col_no > 0").withColumn("base_label", clean_header(F.col("text")))
    same = Window.partitionBy(*keys, "role", "base_label")
    n, i = F.count("*").over(same), F.row_number().over(same.orderBy("col_no"))
    tag = F.when(F.col("role") == "referral", "referral").otherwise("lts")
    shown = F.when(n > 1, F.concat("base_label", F.lit(" ("), i, F.lit(")"))).otherwise(F.col("base_label"))
    return labelled.select(
        *keys,
        F.concat_ws(":", "role", "col_no").alias("column_key"),
        "role",
        F.col("col_no").alias("col_index"),
        "base_label",
        F.concat(shown, F.lit(" ("), F.when(tag == "referral", "referral").otherwise("LTS"), F.lit(")")).alias("display_label"),
        tag.alias("tag"),
    )


def row_values(records: DataFrame) -> DataFrame:
    """``(file_id, role, row_label, value)``: what a form's record writes into the column it was
    assigned to; ``records`` carries ``role``."""
    referral, clinical = F.col("role") == "referral", F.col("effective_type") == CLINICAL
    # Row labels with their field or fixed entry, and where they apply.
    rows = [
        ("Post-LPV storage", F.lit("7"), None),
        ("# post-LPV storage aliquots", F.lit("all aliquots"), None),
        ("Analyte name", F.col("analyte_name_value"), None),
        ("Sample type", F.col("sample_type_value"), None),
        ("Sample vol / collection", F.col("tube_size"), None),
        ("# aliquots/expected sample", F.lit("1"), clinical),
        ("Validated assay", F.col("validated_assay"), referral),
        ("Proprietary assay", F.col("proprietary_assay"), referral),
        ("Ref Lab contract owner", F.col("contact_name"), referral),
        ("Assay lab", F.col("assay_lab"), referral),
        ("Assay lab city, state, country", F.col("assay_lab_location"), referral),
        ("Special collection tube required?", F.lit("Yes"), referral),
        ("Special collection tube", F.col("special_tube"), referral),
        ("# of results per expected sample", F.lit("1"), referral),
    ]
    entries = [
        F.struct(F.lit(name).alias("row_label"), (value if when is None else F.when(when, value)).alias("value")) for name, value, when in rows
    ]
    long = records.select("file_id", "role", F.inline(F.array(*entries)))
    return long.where(F.col("value").isNotNull() & (F.col("value") != ""))


def plan_column_inserts(assigned: DataFrame, registry: DataFrame) -> DataFrame:
    """``(doc_id, file_id, role, col_index, header, inserted)``: files that share a column get
    numbered columns side by side; columns to the right move by the inserts before them.

    ``assigned``: ``(doc_id, file_ord, file_id, column_key)``; ``registry``: the columns of the
    template, ``(column_key, role, col_index, base_label)``.
    """
    known = assigned.join(registry, "column_key")
    placed = carry(known, ["doc_id", "column_key"], "file_ord", {"_i": ("sum", F.lit(1), "upto"), "_n": ("sum", F.lit(1), "all")})
    # One row per used column and document: at most as many as the template has.
    used = placed.groupBy("doc_id", "role", "column_key").agg(F.max("col_index").alias("_at"), (F.max("_n") - 1).alias("_more"))
    left = Window.partitionBy("doc_id", "role").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = used.select("doc_id", "column_key", F.coalesce(F.sum("_more").over(left), F.lit(0)).alias("_shift"))
    return placed.join(shift, ["doc_id", "column_key"]).select(
        "doc_id",
        "file_id",
        "role",
        (F.col("col_index") + F.col("_shift") + F.col("_i") - 1).alias("col_index"),
        F.when(F.col("_n") > 1, F.concat("base_label", F.lit(" ("), "_i", F.lit(")"))).otherwise(F.col("base_label")).alias("header"),
        (F.col("_i") > 1).alias("inserted"),
    )


def shared_rows(plan: DataFrame) -> DataFrame:
    """``(doc_id, role, row_label, value)``: the fixed rows of every table that got a file."""
    labels = F.explode(F.array(*[F.lit(r) for r in SHARED_ROWS]))
    return plan.select("doc_id", "role").distinct().select("doc_id", "role", labels.alias("row_label"), F.lit("frozen").alias("value"))


def match_columns(registry: DataFrame, heads: DataFrame) -> DataFrame:
    """``(file_id, column_key, col_index)``: registry columns found in another file's header by
    substring, the k-th of equal labels at the k-th such header. ``registry`` is one template's;
    its labels travel with the role, so the join is on the role."""
    same = Window.partitionBy("role", "base_label").orderBy("col_index")
    ranked = registry.withColumn("_k", F.row_number().over(same))
    labels = ranked.groupBy("role").agg(F.collect_set(F.lower("base_label")).alias("_labels"))
    found = heads.where("col_no > 0").join(labels, "role").select(
        "file_id", "role", "col_no", F.explode(F.filter("_labels", lambda x: F.contains(F.lower("text"), x))).alias("_label")
    )
    order = Window.partitionBy("file_id", "role", "_label").orderBy("col_no")
    found = found.withColumn("_k", F.row_number().over(order))
    return ranked.withColumn("_label", F.lower("base_label")).join(found, ["role", "_label", "_k"]).select(
        "file_id", "column_key", F.col("col_no").alias("col_index")
    )


def is_placeholder(value: Column) -> Column:
    v = F.lower(strip(value))
    return (v == "") | v.isin(*PLACEHOLDERS) | v.startswith("list ") | v.startswith("x ml") | v.rlike(r"^\d+\s*\(default\)$")


def previous_rows(cells: DataFrame, matched: DataFrame) -> DataFrame:
    """``(file_id, role, row_label, column_key, value)`` of an earlier file; ``matched`` says where
    the registry's columns are in it."""
    labels = cells.where("row_no > 0 and col_no = 0").select("file_id", "role", "row_no", strip(F.col("text")).alias("row_label"))
    at = matched.select("file_id", "column_key", F.substring_index("column_key", ":", 1).alias("role"), F.col("col_index").alias("col_no"))
    body = cells.where("row_no > 0").join(at, ["file_id", "role", "col_no"])
    values = body.select("file_id", "role", "row_no", "column_key", strip(F.col("text")).alias("value")).where("value <> ''")
    return values.join(labels.where("row_label <> ''"), ["file_id", "role", "row_no"]).select(
        "file_id", "role", "row_label", "column_key", "value"
    )


def previous_columns(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """``(file_id, column_key, has_data)``: whether any value of the column is more than a placeholder."""
    filled = rows.groupBy("file_id", "column_key").agg(F.bool_or(~is_placeholder(F.col("value"))).alias("has_data"))
    return matched.select("file_id", "column_key").join(filled, ["file_id", "column_key"], "left").select(
        "file_id", "column_key", F.coalesce("has_data", F.lit(False)).alias("has_data")
    )


def default_selection(columns: DataFrame) -> DataFrame:
    return columns.where("has_data").select("file_id", "column_key")


def apply_selection(matched: DataFrame, selected: DataFrame) -> DataFrame:
    """``(file_id, column_key, col_index)`` of the selected columns, moved left by the columns that
    were dropped before them."""
    role = F.substring_index("column_key", ":", 1)
    marked = matched.join(selected.withColumn("_s", F.lit(1)), ["file_id", "column_key"], "left").withColumn("_role", role)
    left = Window.partitionBy("file_id", "_role").orderBy("col_index").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("_s").isNull(), 1).otherwise(0)).over(left), F.lit(0))
    moved = marked.withColumn("_new", F.col("col_index") - gone)
    return moved.where("_s = 1").select("file_id", "column_key", F.col("_new").cast("int").alias("col_index"))


def prefix_label_join(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """``(file_id, row_label, key, value)``: entries of the file whose key starts the row label; the longest key counts, of
    equal keys the largest value. A label is cut only to the lengths that the file's keys have, and its
    beginnings meet the keys by equality, so labels and keys are never paired."""
    one = entries.groupBy("file_id", "key").agg(F.max("value").alias("value"))
    lengths = one.groupBy("file_id").agg(F.collect_set(F.length("key")).alias("_n"))
    cut = F.filter("_n", lambda n: n <= F.length("row_label"))
    starts = labels.select("file_id", "row_label").distinct().join(lengths, "file_id").select("file_id", "row_label", F.explode(cut).alias("_n"))
    met = starts.withColumn("key", F.substring(F.col("row_label"), F.lit(1), F.col("_n"))).join(one, ["file_id", "key"])
    return met.groupBy("file_id", "row_label").agg(F.max_by(F.struct("key", "value"), "_n").alias("b")).select("file_id", "row_label", "b.*")


def locate_table(tables: DataFrame, word: str, min_rows: int = 1, min_cols: int = 1, prefer: str = "rows", title_rows: int = 4) -> DataFrame:
    """``(file_id, table_no)``: the largest table whose title has the word; where that is only a
    title, the table after it. ``tables``: ``(file_id, table_no, title, n_rows, n_cols)``."""
    size = ("n_cols", "n_rows") if prefer == "cols" else ("n_rows", "n_cols")
    rank = F.struct(F.col(size[0]), F.col(size[1]), -F.col("table_no"))
    fits = tables.where(F.lower("title").contains(word.lower()) & (F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols))
    best = fits.groupBy("file_id").agg(F.max_by(F.struct("table_no", "n_rows"), rank).alias("b"))
    following = tables.select("file_id", (F.col("table_no") - 1).alias("_prev"), F.col("table_no").alias("_next"))
    named = best.select("file_id", F.col("b.table_no").alias("_prev"), F.col("b.n_rows").alias("_n"))
    found = named.join(following, ["file_id", "_prev"], "left")
    return found.select(
        "file_id", F.when((F.col("_n") < title_rows) & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("_prev")).alias("table_no")
    )


def single_source(entries: DataFrame) -> DataFrame:
    """Entries of one source per document: forms before an earlier file, never blended."""
    return choose_source(entries, ["doc_id"])


def apply_manual_columns(files: DataFrame, assigned: DataFrame, registry: DataFrame, manual: DataFrame) -> DataFrame:
    """``(file_id, column_key, source)`` of files: a manual choice goes before the column whose base
    label was recognised (its first column where a label repeats). ``files`` holds the new files;
    those that are known already are in ``manual`` and are not added twice."""
    first = registry.groupBy("base_label").agg(F.min_by("column_key", F.struct("role", "col_index")).alias("_auto"))
    auto = assigned.select("file_id", "base_label").join(first, "base_label", "left").select("file_id", "_auto")
    chosen = manual.select("file_id", F.col("column_key").alias("_manual"), F.lit(True).alias("_known"))
    every = files.select("file_id").join(manual, "file_id", "left_anti").unionByName(manual.select("file_id"))
    return every.join(auto, "file_id", "left").join(chosen, "file_id", "left").select(
        "file_id",
        F.when(F.col("_known"), F.col("_manual")).otherwise(F.col("_auto")).alias("column_key"),
        F.when(F.col("_known"), "manual").when(F.col("_auto").isNotNull(), "auto").otherwise("open").alias("source"),
    )
