"""Schedule matrices: which procedure happens at which visit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studylake.functions.fixed import (
    CAPTION_WORDS,
    DAY_HEADER_LABELS,
    DAY_TOKEN,
    DIVIDER_ENDING,
    DROP_ROWS,
    GROUP_TITLE,
    KEEP_ROWS,
    NON_LAB,
    NON_VISIT_HEADERS,
    PAGE_CAPTION,
    PAGE_NOISE,
    PANEL_MARKER,
    PANEL_WORDS,
    VISIT_TOKEN,
)
from studylake.functions.sequence import Steps, _carry_whole, by_length, carry, range_join
from studylake.functions.stage import stage
from studylake.functions.text import any_of, let, squeeze, strip, unescape
from studylake.operators.structure import DOC, detect_line_ranges, inner_cells, lines_in_ranges, split_pipes, split_row

# --- classifiers of header and label texts ------------------------------------------------------


def is_visit_column(header: Column) -> Column:
    """Whether a table header names a visit rather than comments, windows and the like."""
    name = strip(header)
    low = F.lower(name)
    token = rf"(?i)^(?:{VISIT_TOKEN})(?:[\s,/&]+(?:{VISIT_TOKEN}))*$"
    return (
        F.when(low == "", True)
        .when(low.isin(*NON_VISIT_HEADERS), False)
        .otherwise(name.rlike(token) | (F.length(low) <= 8))
    )


def is_non_lab(label: Column) -> Column:
    return strip(label).rlike(any_of(NON_LAB))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_category_header(label: Column, has_content: Column) -> Column:
    """A divider row: no cell filled, and a phrase of two or more words that ends in a category
    noun or is all capitals."""

    def divides(name: Column) -> Column:
        core = strip(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
        phrase = core.contains(" ") & core.rlike(DIVIDER_ENDING)
        capitals = is_upper(name) & name.contains(" ") & F.length(name).between(4, 50) & ~name.rlike(any_of(NON_LAB))
        return (name != "") & (phrase | capitals)

    return ~has_content & let(strip(label), divides)


def is_dropped_row(label: Column) -> Column:
    """Rows to leave out of a combined schedule; a keep word beats a drop word."""
    name = strip(F.coalesce(label, F.lit("")))
    return (name != "") & ~name.rlike(any_of(KEEP_ROWS)) & name.rlike(any_of(DROP_ROWS))


def is_likely_panel(name: Column) -> Column:
    return F.lower(name).rlike("|".join(w.lower() for w in PANEL_WORDS))


def is_page_decoration(label: Column, cells: Column) -> Column:
    """Table captions, and column-group captions that repeat on every page."""
    filled = F.filter(F.transform(cells, strip), lambda c: c != "")
    caption = "^(?:" + "|".join(CAPTION_WORDS) + ")"
    grouped = (
        label.rlike(r"^[A-Za-z0-9]{2,8}$")
        & (F.size(filled) > 0)
        & F.forall(filled, lambda c: F.lower(strip(F.regexp_replace(c, r"[/\s]+$", ""))).rlike(caption))
    )
    return strip(label).rlike(PAGE_CAPTION) | grouped


def is_continuation(label: Column) -> Column:
    return (label != "") & (label.rlike(r"^\p{Ll}") | (F.length(label) < 20))


def drop_nonlab(cells: DataFrame) -> DataFrame:
    """Cells ``(doc_id, row_no, col_no, text)`` of rows whose label is laboratory work."""
    labels = cells.where((F.col("col_no") == 0) & ~is_non_lab(F.col("text"))).select("doc_id", "row_no")
    return cells.join(labels, ["doc_id", "row_no"], "left_semi")


def drop_nonlab_keep_first(cells: DataFrame) -> DataFrame:
    labels = cells.where((F.col("col_no") == 0) & ~is_dropped_row(F.col("text"))).select("doc_id", "row_no")
    return cells.join(labels, ["doc_id", "row_no"], "left_semi")


def category_rows(cells: DataFrame) -> DataFrame:
    """``(doc_id, row_no, label)`` of divider rows."""
    filled = F.max((F.col("col_no") > 0) & (strip(F.col("text")) != ""))
    rows = cells.where("row_no > 0").groupBy("doc_id", "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("label"), F.coalesce(filled, F.lit(False)).alias("_f")
    )
    return rows.where(is_category_header(F.col("label"), F.col("_f"))).select("doc_id", "row_no", "label")


def count_visits(cells: DataFrame) -> DataFrame:
    """Visit columns of the header row per document, the first column aside."""
    heads = cells.where("row_no = 0 and col_no > 0")
    return heads.groupBy("doc_id").agg(F.count_if(is_visit_column(F.col("text"))).alias("visits"))


def select_row_positions(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cells of the rows at the chosen ``(doc_id, row_no)``; labels may repeat."""
    return cells.join(chosen, ["doc_id", "row_no"], "left_semi")


# --- schedule out of pipe rows ---------------------------------------------------------------------


def rejoin_label(cells: Column) -> Column:
    """Up to four short cells right of the label are pieces of it; they are put back and their
    cells left empty. The label stays within 45 characters."""
    start = F.struct(cells[0].alias("label"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        stop = (
            acc["done"]
            | (piece == "")
            | (F.upper(piece) == "X")
            | piece.rlike(DAY_TOKEN)
            | (F.length(piece) > 12)
            | (F.length(acc["label"]) + F.length(piece) > 45)
        )
        return let(
            stop,
            lambda halt: F.struct(
                F.when(halt, acc["label"]).otherwise(F.concat(acc["label"], piece)).alias("label"),
                F.when(halt, acc["used"]).otherwise(acc["used"] + 1).alias("used"),
                halt.alias("done"),
            ),
        )

    joined = let(
        F.aggregate(F.slice(cells, 2, 4), start, step),
        lambda f: F.concat(
            F.array(f["label"]), F.array_repeat(F.lit(""), f["used"]), F.slice(cells, f["used"] + 2, F.size(cells))
        ),
    )
    # Most rows have a mark or nothing right of the label and need no such pass.
    second = F.coalesce(F.get(cells, F.lit(1)), F.lit(""))
    return F.when(second.isin("", "X", "x"), cells).otherwise(joined)


def matrix_rows(lines: DataFrame) -> DataFrame:
    """Pipe rows with what can be told from the row alone: ``kind`` is ``separator``,
    ``decoration``, ``title``, ``day`` (a visit header by its label) or ``other``."""
    text = strip(F.col("text"))
    # Each array of one is a border that no filter is pushed through, so that a row is split and rejoined once. It holds what
    # is compiled or stands over a projection: a step of its own that is not compiled costs more than the splitting.
    split = lines.where(text.startswith("|")).select("doc_id", "line_no", F.explode(F.array(split_pipes(F.col("text")))).alias("_c"))
    split = split.select("doc_id", "line_no", inner_cells(F.col("_c")).alias("raw")).select("doc_id", "line_no", F.explode(F.array("raw")).alias("raw"))
    rejoined = F.when(F.size("raw") > 0, rejoin_label(F.col("raw"))).otherwise(F.array(F.lit("")))
    rows = split.select("doc_id", "line_no", "raw", rejoined.alias("cells")).select("doc_id", "line_no", "raw", F.explode(F.array("cells")).alias("cells"))
    rows = rows.withColumns({"label": F.col("cells")[0], "_filled": F.array_remove(F.slice("cells", F.lit(2), F.size("cells")), "")})
    label, filled = F.col("label"), F.col("_filled")
    return rows.select(
        "doc_id",
        "line_no",
        "raw",
        "cells",
        "label",
        F.when(F.array_join("raw", "").rlike(r"^[-:\s]*$"), "separator")
        .when(is_page_decoration(F.get("raw", F.lit(0)), F.slice("raw", F.lit(2), F.size("raw"))), "decoration")
        .when(label.rlike(GROUP_TITLE), "title")
        .when(F.lower(label).isin(*DAY_HEADER_LABELS), "day")
        .otherwise("other")
        .alias("kind"),
        (F.size(filled) == 0).alias("blank"),
        (
            (label != "") & (F.size(filled) >= 3) & (F.size(F.filter(filled, lambda c: c.rlike(DAY_TOKEN))) * 2 > F.size(filled))
        ).alias("day_like"),
        F.array_join(F.array_remove("raw", ""), "\u0001").alias("signature"),
    )


def merge_header_fragment(cells: Column, above: Column) -> Column:
    """Header cells, each preceded by the cell above; the label itself is kept."""
    width = F.greatest(F.size(cells), F.size(above))
    filled = lambda a: F.concat(a, F.array_repeat(F.lit(""), width - F.size(a)))
    pairs = F.zip_with(filled(cells), filled(above), lambda c, a: strip(F.concat_ws(" ", strip(a), strip(c))))
    return F.concat(F.slice(cells, 1, 1), F.slice(pairs, F.lit(2), F.greatest(width - 1, F.lit(0))))


def with_headers(rows: DataFrame) -> DataFrame:
    """Adds to each row of :func:`matrix_rows` the header it stands under: ``header`` is a
    struct of its line and visit labels, without group titles (:func:`namespace_groups`). A row that
    only looks like a header counts as one while no other header has been seen."""
    return by_length(rows, DOC, "line_no", _headers)


def _headers(rows: DataFrame, step: Steps) -> DataFrame:
    # Only a row without a label can be part of a header, so only its cells are carried on.
    above = F.struct("kind", "label", F.when(F.col("label") == "", F.col("cells")).alias("cells"))
    placed = step.carry(rows, {"_above": ("last", above, "before")})
    fragment = (
        (F.col("_above.kind") == "other")
        & (F.col("_above.label") == "")
        & F.exists(F.slice("_above.cells", F.lit(2), F.greatest(F.size("_above.cells"), F.lit(1))), lambda c: strip(c) != "")
    )
    may_head = (F.col("kind") == "day") | ((F.col("kind") == "other") & F.col("day_like"))
    merged = F.when(fragment, merge_header_fragment(F.col("cells"), F.col("_above.cells"))).otherwise(F.col("cells"))
    placed = placed.withColumn("_merged", F.when(may_head, F.transform(merged, strip)))
    last_filled = F.size("_merged") - F.array_position(F.reverse(F.transform("_merged", lambda c: c != "")), True)
    placed = placed.withColumn("_last", F.when(may_head, last_filled))
    head = F.struct(F.col("line_no").alias("line"), F.slice("_merged", F.lit(2), F.col("_last").cast("int")).alias("visits"))
    placed = placed.withColumn("_h", F.when(F.col("_last") >= 1, head))
    found = step.carry(
        placed,
        {
            "_label_head": ("last", F.when(F.col("kind") == "day", F.col("_h")), "upto"),
            "_shape_head": ("first", F.when(F.col("kind") == "other", F.col("_h")), "upto"),
        },
    )
    header = F.coalesce("_label_head", "_shape_head")
    return found.select(*rows.columns, header.alias("header"), (header["line"] == F.col("line_no")).alias("is_header"))


def drop_dividers(rows: DataFrame) -> DataFrame:
    """Adds ``divider``: the row is a divider or one of up to three rows its label wraps over.

    Candidates are rows without any mark; how many rows a divider still takes is the state of an
    automaton over one letter a row.
    """
    staged = stage(rows)
    return by_length(_raw_label(staged), DOC, "line_no", _dividers).select(*staged.columns, "divider")


def _raw_label(rows: DataFrame) -> DataFrame:
    """Adds what :func:`_dividers` reads of the cells as written, so that these need not be moved: ``label_raw``, and ``_cont``:
    nothing stands right of a label that may continue another one."""
    label, others = F.coalesce(F.get("raw", F.lit(0)), F.lit("")), F.slice("raw", F.lit(2), F.greatest(F.size("raw"), F.lit(1)))
    bare = (F.col("kind") != "separator") & (F.size(F.array_remove(others, "")) == 0)
    return rows.withColumn("label_raw", strip(label)).withColumn("_cont", bare & is_continuation(F.col("label_raw")))


def _dividers(rows: DataFrame, step: Steps) -> DataFrame:
    base = rows.withColumn("_headed", F.col("header").isNotNull())
    near = step.near(base, ["label_raw", "_cont"], 0, 3)
    ok = [F.coalesce(F.col(f"next{i}._cont"), F.lit(False)) for i in (1, 2, 3)]
    used = F.when(ok[0] & ok[1] & ok[2], 3).when(ok[0] & ok[1], 2).when(ok[0], 1).otherwise(0)
    whole = F.concat_ws(
        " ",
        F.col("label"),
        F.when(used >= 1, F.col("next1.label_raw")),
        F.when(used >= 2, F.col("next2.label_raw")),
        F.when(used >= 3, F.col("next3.label_raw")),
    )
    opens = (
        (F.col("kind") == "other")
        & ~F.coalesce(F.col("is_header"), F.lit(False))
        & F.col("_headed")
        & F.col("blank")
        & (F.col("label") != "")
        & is_category_header(whole, F.lit(False))
    )
    # Letters: 0-3 a divider that takes so many rows, 4-7 the same on a row that may itself continue one,
    # "c" a row that only may continue, "r" any other. The state is the number of rows still to take.
    opened, cont = F.coalesce(opens, F.lit(False)), F.col("_cont")
    letter = F.when(opened, (used + F.when(cont, 4).otherwise(0)).cast("string")).when(cont, "c").otherwise("r")
    taken = lambda c: F.when(c < "4", c.cast("int")).otherwise(c.cast("int") - 4)

    def count(left: Column, c: Column) -> Column:
        return F.when(c == "r", 0).when((left > 0) & (c >= "4"), left - 1).when(c == "c", 0).otherwise(taken(c))

    def hit(left: Column, c: Column) -> Column:
        return ((left > 0) & (c >= "4") & (c != "r")) | ((c != "c") & (c != "r"))

    marked = near.select(*rows.columns, letter.alias("_letter")).drop("label_raw", "_cont")
    return step.automaton(marked, F.col("_letter"), 4, count, hit, "divider", "r").drop("_letter")


def namespace_groups(rows: DataFrame) -> DataFrame:
    """Puts the group title above a header in front of its visits, for rows of :func:`drop_dividers`:
    a title that is part of a divider's label is none. Only headers and titles, a few rows per
    document, are put in order; the join back is on the header's line."""
    return by_length(stage(rows), DOC, "line_no", _named)


def _named(rows: DataFrame, step: Steps) -> DataFrame:
    title = F.when((F.col("kind") == "title") & ~F.col("divider"), F.col("label"))
    if step.whole:
        # A row's header is the last header row up to it.
        titled = step.carry(rows, {"_own": ("last", title, "upto")})
        named = step.carry(titled, {"_of": ("last", F.when(F.col("is_header"), F.struct("_own")), "upto")}).withColumn("_title", F.col("_of._own"))
    else:
        few = rows.select("doc_id", "line_no", "is_header", title.alias("_own")).where(F.col("is_header") | F.col("_own").isNotNull())
        heads = step.carry(few, {"_title": ("last", F.col("_own"), "upto")}).where(F.col("is_header") & F.col("_title").isNotNull())
        named = rows.withColumn("_line", F.col("header.line")).join(
            heads.select("doc_id", F.col("line_no").alias("_line"), "_title"), ["doc_id", "_line"], "left"
        )
    visits = F.transform("header.visits", lambda v: F.concat_ws(": ", F.col("_title"), v))
    header = F.when(F.col("_title").isNull(), F.col("header")).otherwise(F.struct(F.col("header.line").alias("line"), visits.alias("visits")))
    return named.withColumn("header", header).select(*rows.columns)


def named_rows(rows: DataFrame) -> DataFrame:
    """:func:`namespace_groups` of :func:`drop_dividers` of :func:`with_headers`, for rows of :func:`matrix_rows`."""
    return by_length(_raw_label(rows), DOC, "line_no", lambda part, step: _named(_dividers(_headers(step.deal(part, "doc_id"), step), step), step))


def drop_repeated(rows: DataFrame, times: int = 3) -> DataFrame:
    """Adds ``repeated``: the filled cells occur at least ``times`` times in the document.
    Counts combine map-side; only counts that reach the limit are joined back."""
    return by_length(rows, DOC, "line_no", lambda part, step: _repeated(part, step, times))


def _repeated(rows: DataFrame, step: Steps, times: int = 3) -> DataFrame:
    if step.whole:
        return rows.withColumn("repeated", F.count("*").over(Window.partitionBy("doc_id", "signature")) >= times)
    often = rows.groupBy("doc_id", "signature").agg(F.count("*").alias("_n")).where(F.col("_n") >= times)
    often = often.select("doc_id", "signature", F.lit(True).alias("repeated"))
    return rows.join(often, ["doc_id", "signature"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


def schedule_rows(lines: DataFrame) -> DataFrame:
    """Data rows of all schedule tables with wrapped labels put together:
    ``(doc_id, table_ord, row_ord, label, visits, marks, comment)``.

    Rows under equal headers form one table; ``table_ord`` is the line of its first header.
    """
    return by_length(_raw_label(matrix_rows(lines)).drop("raw"), DOC, "line_no", _scheduled)


def _scheduled(rows: DataFrame, step: Steps) -> DataFrame:
    """Short documents are dealt out once, and all further steps find them together; rows of longer ones are stored."""
    done = _repeated(_named(_dividers(_headers(step.deal(rows, "doc_id"), step), step), step), step).drop("signature")
    keyed = done.withColumn("table_key", F.array_join("header.visits", "\u0001"))
    out = ["doc_id", "row_ord", "label", "visits", "marks", "comment", "table_ord"]
    if step.whole:
        first = F.min(F.when(F.col("is_header"), F.col("line_no"))).over(Window.partitionBy("doc_id", "table_key"))
        return _continued(_data_rows(keyed.withColumn("table_ord", first)), _carry_whole).select(*out)
    keyed = stage(keyed)
    heads = keyed.where("is_header").groupBy("doc_id", "table_key").agg(F.min("line_no").alias("table_ord"))
    return merge_continuations(_data_rows(keyed.withColumn("table_ord", F.lit(0)))).join(heads, ["doc_id", "table_key"]).select(*out)


def _data_rows(rows: DataFrame) -> DataFrame:
    end = F.size("header.visits")
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(end + 1 - F.size("cells"), F.lit(0))))
    marks = F.transform(F.slice(filled, F.lit(2), end), strip)
    rest = F.filter(F.transform(F.slice("cells", end + 2, F.size("cells")), strip), lambda c: c != "")
    return rows.where(
        (F.col("kind") == "other")
        & ~F.coalesce("is_header", F.lit(False))
        & F.col("header").isNotNull()
        & ~F.col("divider")
        & ~F.col("repeated")
        & (F.col("label") != "")
        & ~is_page_decoration(F.col("label"), F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))))
    ).select(
        "doc_id",
        "line_no",
        "table_key",
        "table_ord",
        "label",
        F.col("header.visits").alias("visits"),
        marks.alias("marks"),
        F.array_join(rest, " ").alias("comment"),
    )


def merge_continuations(data: DataFrame) -> DataFrame:
    """Rows without marks whose label is a fragment are added to the row above them in the
    same table, label and comment."""
    return _continued(data.withColumn("table_ord", F.lit(0)), carry).drop("table_ord")


def _continued(data: DataFrame, carried: Callable[..., DataFrame]) -> DataFrame:
    """:func:`merge_continuations` of rows that know their ``table_ord``, one for all rows of a table."""
    goes_on = (F.size(F.array_remove("marks", "")) == 0) & is_continuation(F.col("label"))
    specs = {
        "_row": ("last", F.when(~goes_on, F.col("line_no")), "upto"),
        "_first": ("min", F.col("line_no"), "upto"),
    }
    grouped = carried(data, specs=specs, keys=["doc_id", "table_key"], order="line_no").withColumn("row_ord", F.coalesce("_row", "_first"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "label", "comment")))
    return (
        grouped.groupBy("doc_id", "table_key", "row_ord")
        .agg(
            parts.alias("_p"), F.min_by("visits", "line_no").alias("visits"), F.min_by("marks", "line_no").alias("marks"), F.min("table_ord").alias("table_ord")
        )
        .select(
            "doc_id",
            "table_key",
            "table_ord",
            "row_ord",
            F.array_join(F.transform("_p", lambda p: p["label"]), " ").alias("label"),
            "visits",
            "marks",
            F.array_join(F.array_remove(F.transform("_p", lambda p: p["comment"]), ""), " ").alias("comment"),
        )
    )


def schedule_marks(rows: DataFrame) -> DataFrame:
    """Long form, one row per procedure and visit. Of equal visit labels in one table the last
    column counts."""
    zipped = F.arrays_zip("visits", "marks")
    cells = rows.select("doc_id", "table_ord", "row_ord", "label", "comment", "visits", F.posexplode(zipped).alias("visit_ord", "_z"))
    later = F.slice("visits", F.col("visit_ord") + 2, F.size("visits"))
    return cells.where(~F.array_contains(later, F.col("_z.visits"))).select(
        "doc_id", "table_ord", "row_ord", "label", "visit_ord", F.col("_z.visits").alias("visit"), F.col("_z.marks").alias("mark"), "comment"
    )


def union_visits(marks: DataFrame) -> DataFrame:
    """``(doc_id, visit, table_ord, visit_ord)``: all visits at the place they are first seen."""
    seen = F.min(F.struct("table_ord", "visit_ord"))
    return marks.groupBy("doc_id", "visit").agg(seen.alias("s")).select("doc_id", "visit", "s.*")


def merge_rows_by_label(marks: DataFrame) -> DataFrame:
    """``(doc_id, label, visit, mark)``: the first filled mark of a label over all tables."""
    place = F.struct("table_ord", "row_ord", "visit_ord")
    return (
        marks.where(F.col("mark") != "")
        .groupBy("doc_id", "label", "visit")
        .agg(F.min_by("mark", place).alias("mark"))
    )


def merge_comments(rows: DataFrame) -> DataFrame:
    """``(doc_id, label, comment)``: distinct comments of a label in order of first use."""
    place = F.min(F.struct("table_ord", "row_ord"))
    distinct = rows.groupBy("doc_id", "label", "comment").agg(place.alias("_at"))
    listed = F.sort_array(F.collect_list(F.when(F.col("comment") != "", F.struct("_at", "comment"))))
    return distinct.groupBy("doc_id", "label").agg(
        F.min("_at").alias("_at"), F.array_join(F.transform(listed, lambda c: c["comment"]), " ").alias("comment")
    ).select("doc_id", "label", F.col("_at.table_ord").alias("table_ord"), F.col("_at.row_ord").alias("row_ord"), "comment")


def pivot_matrix(marks: DataFrame, visits: list[str]) -> DataFrame:
    """Wide matrix over an explicit list of visits."""
    return marks.groupBy("doc_id", "label").pivot("visit", visits).agg(F.first("mark")).na.fill("", visits)


def unpivot_matrix(wide: DataFrame, visits: list[str]) -> DataFrame:
    return wide.unpivot(["doc_id", "label"], visits, "visit", "mark").where(F.col("mark") != "")


# --- laboratory appendix -------------------------------------------------------------------------------

REVIEW_ROW = "‹REVIEW:Lab Appendix section — could not parse table structure›"


def appendix_rows_with_review(lines: DataFrame, min_prose: int = 60) -> DataFrame:
    """``(doc_id, line_no, test, comment)``: table rows, and one review row for each stretch of
    prose between them that is long enough to matter."""
    text = strip(F.col("text"))
    cells = split_row(text)
    row = lines.where(text != "").select("doc_id", "line_no", text.alias("text"), F.when(text.startswith("|"), cells).alias("c"))
    label = strip(F.try_element_at("c", F.lit(1)))
    is_row = (
        F.col("c").isNotNull()
        & ~F.forall("c", lambda c: c.rlike(r"^[-:\s]*$"))
        & (label != "")
        & ~label.rlike(r"(?i)^clinical\s+laboratory\s+tests$")
    )
    placed = carry(
        row.withColumn("_r", F.coalesce(is_row, F.lit(False))),
        DOC,
        "line_no",
        {"_prev": ("last", F.when(F.col("_r"), F.col("line_no")), "upto")},
    )
    rest = F.filter(F.slice("c", F.lit(2), F.size("c")), lambda c: c != "")
    tests = placed.where("_r").select("doc_id", "line_no", label.alias("test"), F.array_join(rest, " ").alias("comment"))
    prose = placed.where(F.col("c").isNull() & ~F.col("text").rlike(any_of(PAGE_NOISE[:1])))
    prose = prose.withColumn("text", F.regexp_replace("text", r"^#+\s*", ""))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    stretches = prose.groupBy("doc_id", F.coalesce("_prev", F.lit(-1)).alias("_prev")).agg(
        F.min("line_no").alias("line_no"), strip(F.array_join(parts, " ")).alias("comment")
    )
    review = stretches.where(F.length("comment") >= min_prose).select(
        "doc_id", "line_no", F.lit(REVIEW_ROW).alias("test"), "comment"
    )
    return tests.unionByName(review)


# --- schedule and panels out of plain lines ----------------------------------------------------------------


def parse_schedule_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, name, line_no, is_panel, visits)`` from lines of the schedule range: columns are
    two or more blanks apart, an ``X`` in the j-th column means the j-th visit number."""
    return by_length(lines, DOC, "line_no", _schedule_tests)


def _schedule_tests(lines: DataFrame, step: Steps) -> DataFrame:
    # Pieces between runs of blanks have none at their ends.
    parts = F.array_remove(F.split(strip(F.col("text")), r"\s{2,}"), "")
    rows = lines.select("doc_id", "line_no", F.upper("text").contains("VISIT NUMBER").alias("_v"), F.explode(F.array(parts)).alias("_p"))
    numbers = F.transform(F.filter("_p", lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int"))
    rows = rows.select("doc_id", "line_no", "_p", F.when(F.col("_v"), F.struct("line_no", numbers.alias("n"))).alias("_v"))
    in_order = lambda listed: F.flatten(F.transform(F.sort_array(listed), lambda s: s["n"]))
    if step.whole:
        # A schedule has few lines of visit numbers; they go with each line of a short document.
        rows = step.deal(rows, "doc_id").select("*", F.collect_list("_v").over(Window.partitionBy("doc_id")).alias("_listed"))
    name = F.col("_p")[0]
    header = (
        r"(?i)^(?:Visit\s*Number|Weeks?|Visit\s*Interval|Visit\s*Detail|Period\s*[IVX]+|Table\s*\d+)|CONFIDENTIAL"
    )
    marks = F.filter(
        F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda p, i: F.when(p.rlike(r"\bX\b"), i + 1)),
        lambda i: i.isNotNull(),
    )
    named = (
        rows.where(F.size("_p") >= 2)
        .where(~name.rlike(header) & ~name.contains("Laboratory tests and sample") & (F.length(name) > 2))
        .select("doc_id", "line_no", name.alias("name"), marks.alias("_x"), *(["_listed"] if step.whole else []))
        .where(F.size("_x") > 0)
    )
    if step.whole:
        body = named.withColumn("_visits", in_order(F.col("_listed")))
    else:
        # One row per document, spread over its blocks.
        visits = rows.groupBy("doc_id").agg(
            in_order(F.collect_list("_v")).alias("_visits"), F.min("line_no").alias("_from"), (F.max("line_no") + 1).alias("_to")
        )
        body = range_join(named, visits, DOC, "line_no", "_from", "_to")
    at = F.array_distinct(
        F.filter(
            F.transform("_x", lambda i: F.try_element_at("_visits", i.cast("int"))),
            lambda v: v.isNotNull(),
        )
    )
    latest = body.select("doc_id", "name", "line_no", at.alias("visits")).groupBy("doc_id", "name").agg(
        F.max("line_no").alias("line_no"), F.max_by("visits", "line_no").alias("visits")
    )
    return latest.select("doc_id", "name", "line_no", is_likely_panel(F.col("name")).alias("is_panel"), "visits")


def clean_analyte_name(line: Column) -> Column:
    """The analyte a line names, null for notes, bullets and headers."""
    text = strip(line)
    note = (
        text.rlike(r"^(?:If |Performed|-)")
        | text.rlike(PANEL_MARKER)
        | F.upper(text).rlike("CONFIDENTIAL|APPROVED ON")
        | text.rlike(r"^\d+\s+\w")
        | (text.contains("Clinical Laboratory Tests") & text.contains("Comments"))
    )
    plain = strip(F.substring_index(F.substring_index(text, ",", 1), "(", 1))
    first = F.regexp_extract(text, r"^(\S+)", 1)
    skipped = ("The", "And", "For", "Not", "See", "With", "That", "This", "Evaluated", "Collected")
    cut = strip(F.substring_index(F.substring_index(F.substring_index(text, "(", 1), ",", 1), "  ", 1))
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"\s+If\s+.*$", ""), r"\s+Evaluated\s+.*$", ""), r"\s+Performed\s+.*$", "")
    named = first.rlike(r"^[A-Z][a-zA-Z\-.]+$") & (F.length(first) > 2) & ~first.isin(*skipped)
    return (
        F.when((text == "") | note, None)
        .when(text.rlike(r"^[A-Z][a-zA-Z\-\s]+$") & (F.length(plain) > 2), plain)
        .when(named, F.nullif(cut, F.lit("")))
    )


def panel_lines(lines: DataFrame) -> DataFrame:
    """``(doc_id, panel_no, name, is_standalone, line_no, test)``: a marker line opens a panel
    (``test`` null), following lines are its analytes. A panel whose next line is again a marker
    stands alone and takes none."""
    text = strip(F.col("text"))
    marker = text.rlike(PANEL_MARKER)
    before = squeeze(F.regexp_extract(text, "(?i)^(.*?)" + PANEL_MARKER.removeprefix("(?i)"), 1))
    panel = F.struct(F.col("line_no").alias("panel_no"), F.regexp_replace(before, r":+\s*$", "").alias("name"))
    owned = carry(
        lines.select("doc_id", "line_no", "text", marker.alias("_m"), F.when(marker, panel).alias("_p")),
        DOC,
        "line_no",
        {"_next": ("first", F.col("_m"), "after"), "_panel": ("last", F.col("_p"), "upto")},
    ).where(F.col("_panel").isNotNull())
    # A border, so that a name is read once.
    owned = owned.select("*", F.explode(F.array(F.when(~F.col("_m"), clean_analyte_name(F.col("text"))))).alias("_test"))
    test = F.col("_test")
    alone = F.col("_m") & F.coalesce("_next", F.lit(False))
    return owned.where(F.col("_m") | test.isNotNull()).select(
        "doc_id", "_panel.*", alone.alias("is_standalone"), "line_no", test.alias("test")
    )


def parse_panels(lines: DataFrame) -> DataFrame:
    """``(doc_id, panel_no, name, is_standalone, tests)``; a panel lists few analytes."""
    rows = F.sort_array(F.collect_list(F.when(F.col("test").isNotNull(), F.struct("line_no", "test"))))
    return panel_lines(lines).groupBy("doc_id", "panel_no", "name").agg(
        F.bool_or("is_standalone").alias("is_standalone"), F.transform(rows, lambda r: r["test"]).alias("tests")
    )


def resolve_standalone(panels: DataFrame, tests: DataFrame) -> DataFrame:
    """Panels that stand alone and are named like a schedule test that is no panel get that test."""
    single = tests.where(~F.col("is_panel")).select("doc_id", "name", F.lit(True).alias("_single"))
    joined = panels.join(single, ["doc_id", "name"], "left")
    return joined.select(
        "doc_id",
        "panel_no",
        "name",
        "is_standalone",
        F.when(F.col("is_standalone") & F.col("_single"), F.array("name")).otherwise(F.col("tests")).alias("tests"),
    )


def visit_to_tests(tests: DataFrame) -> DataFrame:
    """``(doc_id, visit, tests)`` with sorted test names."""
    return (
        tests.select("doc_id", "name", F.explode("visits").alias("visit"))
        .groupBy("doc_id", "visit")
        .agg(F.sort_array(F.collect_set("name")).alias("tests"))
    )


def consolidated_schedule(tests: DataFrame, panels: DataFrame) -> DataFrame:
    """``(doc_id, source, place, category, test, visits)``: schedule tests, then analytes of the
    panels not yet listed, with the visits of the test named like their panel."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    by_name = panels.groupBy("doc_id", low("name").alias("_k")).agg(F.min_by("name", "panel_no").alias("_panel"))
    scheduled = tests.withColumn("_k", low("name"))
    rows = scheduled.join(by_name, ["doc_id", "_k"], "left").select(
        "doc_id",
        F.lit(1).alias("source"),
        F.struct(F.col("line_no").alias("at"), F.lit(0).alias("n")).alias("place"),
        F.coalesce("_panel", F.lit("Other")).alias("category"),
        F.col("name").alias("test"),
        "visits",
    )
    listed = F.when(F.size("tests") > 0, F.col("tests")).when(F.col("is_standalone"), F.array("name"))
    analytes = panels.select("doc_id", "panel_no", "name", F.posexplode(listed).alias("n", "test")).withColumn("_k", low("test"))
    fresh = (
        analytes.where("_k <> ''")
        .groupBy("doc_id", "_k")
        .agg(F.min_by(F.struct("panel_no", "name", "n", "test"), F.struct("panel_no", "n")).alias("a"))
        .join(scheduled.select("doc_id", "_k"), ["doc_id", "_k"], "left_anti")
        .select("doc_id", "a.*")
    )
    panel_visits = scheduled.groupBy("doc_id", "_k").agg(F.max_by("visits", "line_no").alias("visits"))
    inherited = fresh.withColumn("_k", low("name")).join(panel_visits, ["doc_id", "_k"], "left").select(
        "doc_id",
        F.lit(2).alias("source"),
        F.struct(F.col("panel_no").alias("at"), F.col("n")).alias("place"),
        F.col("name").alias("category"),
        "test",
        F.coalesce("visits", F.array().cast("array<int>")).alias("visits"),
    )
    return rows.unionByName(inherited)


def schedule_parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schedule tests and panels of documents, each from its own range of lines. One pass tags the lines
    with the range they lie in; both results are narrow and stored, as everything after reads them several times."""
    tagged = stage(lines_in_ranges(lines))
    of = lambda part: tagged.where(F.col("part") == part).drop("part")
    tests = stage(parse_schedule_lines(of("schedule")))
    return tests, stage(resolve_standalone(parse_panels(of("lab")), tests))


def schedule_json(tests: DataFrame, panels: DataFrame) -> DataFrame:
    """``(doc_id, json)``: tests, panels and visits of a document as one nested record."""
    test = tests.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("name", "is_panel", "visits"))).alias("tests"))
    panel = panels.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("panel_no", "name", "is_standalone", "tests"))),
            lambda p: F.struct(p["name"].alias("name"), p["is_standalone"].alias("is_standalone"), p["tests"].alias("tests")),
        ).alias("panels")
    )
    visit = visit_to_tests(tests).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("visit").alias("visit_number"), "tests"))).alias("visits")
    )
    joined = test.join(panel, "doc_id", "full_outer").join(visit, "doc_id", "full_outer")
    record = F.struct(
        F.struct("tests").alias("schedule_of_activities"), F.struct("panels").alias("lab_appendix"), F.col("visits").alias("master_schedule")
    )
    return joined.select("doc_id", F.to_json(record).alias("json"))


# --- tables over several pages ---------------------------------------------------------------------------------


def combine_tables(cells: DataFrame, name: Column, schedule: Column, by_name: bool = False) -> DataFrame:
    """Stacks tables of one name downward: ``(doc_id, name, table_ord, row_no, col_no, column, text)``.

    The header is that of the first table, widened to the widest row (``Column N``); each
    table's own header row is left out. Cells ``text`` null mark a page without a table.
    Unless ``by_name``, rows without a key are dropped, and of schedules the rows that are not
    laboratory work. Rows stay identified by table and row number, so nothing is renumbered.
    """
    keyed = cells.withColumn("name", name).where(F.col("text").isNotNull())
    shape = keyed.groupBy("doc_id", "name").agg((F.max("col_no") + 1).alias("_w"), F.min("table_ord").alias("_t"))
    rows = keyed.groupBy("doc_id", "name", "table_ord", "row_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("_c")
    )
    head = (
        rows.where("row_no = 0")
        .join(shape, ["doc_id", "name"])
        .where("table_ord = _t")
        .select("doc_id", "name", "_w", F.col("_c").alias("_h"))
    )
    label = F.trim(F.coalesce(F.try_element_at("_c", F.lit(0)), F.lit("")))
    body = rows.where("row_no > 0")
    if not by_name:
        body = body.where((label != "") & ~(schedule & is_dropped_row(label)))
    wide = body.join(head, ["doc_id", "name"]).select("*", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)).alias("col_no"))
    column = F.coalesce(
        F.nullif(F.try_element_at("_h", F.col("col_no")), F.lit("")), F.concat(F.lit("Column "), F.col("col_no") + 1)
    )
    return wide.select(
        "doc_id",
        "name",
        "table_ord",
        "row_no",
        "col_no",
        column.alias("column"),
        F.coalesce(F.try_element_at("_c", F.col("col_no")), F.lit("")).alias("text"),
    )


def combine_page_tables(cells: DataFrame) -> DataFrame:
    return combine_tables(cells, F.trim("table_name"), F.col("name") == "SoA")


def skipped_pages(cells: DataFrame) -> DataFrame:
    """``(doc_id, page)`` of pages that came without a table."""
    return cells.groupBy("doc_id", "page").agg(F.count("text").alias("n")).where("n = 0").select("doc_id", "page")


def merge_named_tables(cells: DataFrame) -> DataFrame:
    """All tables whose names are equal apart from case, rows unchanged."""
    return combine_tables(cells, F.lower(F.trim("table_name")), F.lit(False), by_name=True)


def merge_page_blocks(pages: DataFrame) -> DataFrame:
    """``(doc_id, page, row_no, col_no, text)``: the tables of a page from top to bottom."""
    order = F.array_sort(
        F.transform("blocks", lambda b, i: F.struct(b["bbox"][1].alias("top"), i.alias("i"), b["html"].alias("html")))
    )

    def rows(html: Column) -> Column:
        trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
        return F.transform(
            trs,
            lambda tr: F.transform(
                F.regexp_extract_all(tr, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)),
                lambda td: unescape(F.regexp_replace(td, r"<[^>]+>", "")),
            ),
        )

    stacked = pages.select("doc_id", "page", F.posexplode(F.flatten(F.transform(order, lambda b: rows(b["html"])))).alias("row_no", "_r"))
    return stacked.select("doc_id", "page", "row_no", F.posexplode("_r").alias("col_no", "text"))


def choose_source(candidates: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Rows of the best source that has any, per key. Ranks combine map-side; the join key
    includes the rank."""
    best = candidates.groupBy(*keys).agg(F.min(rank).alias(rank))
    return candidates.join(best, [*keys, rank], "left_semi")
