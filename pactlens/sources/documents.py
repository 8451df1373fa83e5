"""Document sources, validity, metadata, labels and sinks (S1-S5, S9); the store is in ``store`` (S6), matrices as text in ``text_matrix``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.operators.pages import cut_texts, gathered_pages

NO_TEXT = "The submitted text is empty or contains only whitespace."
TOO_SHORT = "The submitted text is shorter than 10 characters."
NO_PAGES = "The uploaded PDF contains 0 pages."
NO_PAGE_TEXT = "The uploaded PDF contains no extractable machine-readable text."
WRONG_TYPE = "Unsupported file format. Only machine-readable PDF files are accepted."


def content_id(raw_text: Column) -> Column:
    """A document id that a rerun finds again."""
    return F.concat(F.lit("doc_"), F.left(F.sha2(raw_text, 256), F.lit(12)))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file, ``(document_id, title, raw_text)``."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_name"))
    return files.select(
        F.regexp_replace("path", r"\.[^.]*$", "").alias("document_id"),
        F.col("path").alias("title"), F.col("value").alias("raw_text"),
    )


def check_texts(texts: DataFrame) -> DataFrame:
    """S3: adds ``reject_reason`` to submitted texts, null for an acceptable one."""
    return texts.withColumn(
        "reject_reason",
        F.when(T.is_blank(F.col("raw_text")), NO_TEXT).when(F.length("raw_text") < 10, TOO_SHORT),
    )


def check_paged(pages: DataFrame, names: DataFrame) -> DataFrame:
    """S3: ``(document_id, filename, reject_reason)`` for uploaded paged documents."""
    sizes = pages.groupBy("document_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.length(T.strip(F.col("text")))).alias("n_chars")
    )
    return names.join(sizes, "document_id", "left").select(
        "document_id", "filename",
        F.when(~F.lower("filename").endswith(".pdf"), WRONG_TYPE)
        .when(F.coalesce("n_pages", F.lit(0)) == 0, NO_PAGES)
        .when(F.col("n_chars") == 0, NO_PAGE_TEXT).alias("reject_reason"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reject_reason is null").drop("reject_reason")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where("reject_reason is not null")


def from_texts(texts: DataFrame) -> DataFrame:
    """Documents of plain texts ``(document_id, raw_text[, title])``."""
    title = F.col("title") if "title" in texts.columns else F.lit(None).cast("string")
    return with_metadata(texts.select(
        "document_id", F.coalesce(title, F.lit("pasted_text.txt")).alias("filename"),
        F.lit("text").alias("source_type"), "raw_text", T.clean_text(F.col("raw_text")).alias("cleaned_text"),
        F.lit(1).alias("page_count"),
    ))


def single_pages(documents: DataFrame) -> DataFrame:
    """The one page of every text document."""
    return documents.select(
        "document_id", F.lit(1).alias("page_number"), F.col("raw_text").alias("text"),
        F.lit(0).alias("char_start"), F.length("raw_text").alias("char_end"),
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    """Adds the character range of every page in the text of its document."""
    before = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return pages.withColumn("char_start", start).withColumn(
        "char_end", (F.col("char_start") + F.length("text")).cast("int")
    )


def from_pages(pages: DataFrame) -> DataFrame:
    """Documents of page texts ``(document_id, page_number, text)``; one scan and one exchange."""
    texts = F.transform("pages", lambda p: p["text"])
    return with_metadata(gathered_pages(pages.select("document_id", "page_number", "text")).select(
        "document_id", F.lit("uploaded_document.pdf").alias("filename"), F.lit("pdf").alias("source_type"),
        F.array_join(texts, "\n").alias("raw_text"), T.clean_text(F.array_join(cut_texts(texts), "\n\n")).alias("cleaned_text"),
        F.size("pages").alias("page_count"),
    ))


def with_metadata(documents: DataFrame) -> DataFrame:
    """Packs page and character counts into ``metadata``."""
    return documents.withColumn("metadata", F.struct(
        "page_count", F.length("raw_text").alias("total_raw_chars"),
        F.length("cleaned_text").alias("total_cleaned_chars"),
    )).drop("page_count")


# -- labelled data (S5) ---------------------------------------------------------------

# The fields of the label files.
LABEL_SCHEMAS = {
    "clauses": "document_id string, clause_id string, clause_index int, section_title string, text string, expected_primary_category string, "
    "expected_secondary_categories array<string>, expected_attention_level string, source string, rationale string",
    "relationships": "document_id string, source_clause_id string, target_clause_id string, expected_relationship_type string, source string, rationale string",
    "queries": "query string, document_id string, relevant_clause_ids array<string>, rationale string",
    "questions": "question_id string, document_id string, question string, category string, expected_answerable boolean, "
    "expected_source_clause_ids array<string>, required_facts array<string>, forbidden_claims array<string>, ground_truth_notes string",
}


def read_labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of one list (``kind``) of nested JSON label files."""
    return spark.read.json(path, schema=f"{kind} array<struct<{LABEL_SCHEMAS[kind]}>>", multiLine=True).select(F.inline(kind))


# -- sinks (S9) and layout ------------------------------------------------------------


def write_bucketed(rows: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Documents or clauses as a table bucketed and sorted by ``document_id``: ingest and search read it without an exchange."""
    writer = rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "document_id").sortBy("document_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    metrics.write.mode("overwrite").json(path)
