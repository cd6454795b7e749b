"""Sources: study tables, raw content, pages, the field catalog, and stored keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("html", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)


def select_study_tables(
    study: DataFrame, country: DataFrame, enrollment: DataFrame, milestone: DataFrame
) -> dict[str, DataFrame]:
    """The columns and rows the study extract needs; projections and filters reach the scan."""
    known = F.col("alias").isNotNull()
    return {
        "study": study.where(known).select("alias", "phase_raw", "area", "pediatric_raw"),
        "country": country.where(known & F.col("country").isNotNull()).select("alias", "country", "abbr", "status"),
        "enrollment": enrollment.where(known & (F.col("plan_kind") == "Planned")).select("alias", "enrollment_type", "total"),
        "milestone": milestone.where(known).select("alias", "milestone_type", "milestone_date"),
    }


def read_study_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = ("study", "study_country", "enrollment", "milestone")
    return select_study_tables(*[spark.read.parquet(f"{folder}/{n}.parquet") for n in names])


CONTENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])


def read_content(spark: SparkSession, paths: str | Sequence[str], fmt: str = "markdown", packed: bool = False) -> DataFrame:
    """``(path, format, content)``, one row per file. ``packed``: the folders hold container files of many contents each
    (:func:`studylake.sources.sinks.pack_content`), since listing and opening a file costs more than reading a small one."""
    if packed:
        files = spark.read.schema(CONTENT).parquet(*([paths] if isinstance(paths, str) else paths))
        return files.select("path", F.lit(fmt).alias("format"), "content")
    files = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.lit(fmt).alias("format"), F.col("value").alias("content"))


def pick_pages(pages: DataFrame, wanted: Sequence[int] | None) -> DataFrame:
    """Only the wanted pages; numbers that do not exist are ignored."""
    return pages if wanted is None else pages.where(F.col("page").isin(list(wanted)))


def read_pages(spark: SparkSession, path: str, pages: Sequence[int] | None = None, fmt: str = "parquet") -> DataFrame:
    """Page rows with their table blocks; a page subset is filtered in the scan."""
    return pick_pages(spark.read.schema(PAGE).format(fmt).load(path), pages)


def pages_with_tables(pages: DataFrame) -> DataFrame:
    return pages.where(F.size("blocks") > 0)


def to_pages(blocks: DataFrame) -> DataFrame:
    """Pages from one row per block (``block_no``, ``top``, ``html``; null html without a block).
    The number of blocks on a page is small, so collecting them is bounded."""
    block = F.struct(
        F.concat_ws("-", F.lit("table"), F.col("page"), F.col("block_no")).alias("id"),
        F.col("page").cast("int").alias("page"),
        F.lit("Table").alias("label"),
        F.array(F.lit(0.0), F.col("top").cast("double"), F.lit(1000.0), F.lit(1000.0)).alias("bbox"),
        F.col("html"),
        F.lit("Table").alias("text"),
    )
    pages = blocks.withColumn("page", F.col("page").cast("int")).groupBy("doc_id", "page").agg(
        F.first("text").alias("text"), F.sort_array(F.collect_list(F.when(F.col("html").isNotNull(), block))).alias("blocks")
    )
    return pages.select(*[F.col(f.name).cast(f.dataType) for f in PAGE.fields if f.name in pages.columns])


CATALOG_LISTS = ("protocol_fields", "design_fields", "rfp_engine_fields")


def read_field_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(list_name, ord, field, source_type, source, primary, fallback, template_label,
    match_phrases)`` from a catalog file with three field lists (the last may be nested)."""
    spec = T.ArrayType(
        T.StructType(
            [
                T.StructField(n, T.StringType())
                for n in ("field", "source_type", "source", "primary", "fallback", "template_label", "primary_value_if_truthy")
            ]
            + [T.StructField("match_phrases", T.ArrayType(T.StringType()))]
        )
    )
    nested = T.StructType([T.StructField("fields", spec)])
    schema = T.StructType(
        [T.StructField("protocol_fields", spec), T.StructField("design_fields", spec), T.StructField("rfp_engine_fields", nested)]
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)

    def unfold(name: str, col: Column) -> DataFrame:
        return doc.select(F.lit(name).alias("list_name"), F.posexplode(col).alias("ord", "s")).select("list_name", "ord", "s.*")

    lists = [unfold(n, F.col(n if n != "rfp_engine_fields" else "rfp_engine_fields.fields")) for n in CATALOG_LISTS]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or no file in it
            raise
        return None


def existing_keys(spark: SparkSession, path: str, key: str, schema: str = "string", within: Column | None = None) -> DataFrame:
    """Non-blank keys already stored, on request only those ``within`` some partitions; none if the table does not exist
    yet. A stored table without the key is an error."""
    table = stored_table(spark, path)
    if table is None:
        return spark.createDataFrame([], f"{key} {schema}")
    stored = (table if within is None else table.where(within)).select(F.col(key))
    return stored.where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
