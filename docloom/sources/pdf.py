"""Page text and font spans to elements; the extractor that yields spans is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import (
    BOLD_HEADING_CHARS, HEADING_SIZE, NEAR_BODY, OCR_PAGE_CHARS, PDF_DEFAULT_SIZE, PDF_MIN_CHARS, PDF_MIN_SIZES, PDF_SAMPLE_PAGES, TOP_HEADING_SIZE,
)
from docloom.functions.text import ustrip


def is_bold(font: str = "font", flags: str = "flags"):
    return F.coalesce(F.rlike(font, F.lit("Bold|bold")), F.lit(False)) | (F.coalesce(F.col(flags), F.lit(0)).bitwiseAND(16) != 0)


def elements(spans: DataFrame) -> DataFrame:
    """``(doc_id, page, pos, element_type, content, level)`` from spans ``(doc_id, page, pos, text, size, font, flags)``.

    The body size is the exact median of the first pages' spans.  A page of
    too little text is a placeholder for OCR; every page ends with a blank.
    """
    sized = F.when((F.col("page") <= PDF_SAMPLE_PAGES) & (ustrip("text") != ""), F.col("size").cast("double"))
    by_doc, by_page = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "page")
    seen = spans.withColumns({"body": F.coalesce(F.percentile(sized, F.lit(0.5)).over(by_doc), F.lit(PDF_DEFAULT_SIZE)), "page_chars": F.sum(F.length("text")).over(by_page)})
    size = F.col("size").cast("double")
    heading = (size >= HEADING_SIZE * F.col("body")) | (is_bold() & (F.length(ustrip("text")) < BOLD_HEADING_CHARS) & (F.abs(size - F.col("body")) <= NEAR_BODY * F.col("body")))
    level = F.when(~heading, 0).when(size >= TOP_HEADING_SIZE * F.col("body"), 1).otherwise(2)
    texts = seen.where((F.col("page_chars") >= OCR_PAGE_CHARS) & (ustrip("text") != "")).select("doc_id", "page", F.col("pos").cast("long").alias("pos"), F.when(heading, "heading").otherwise("paragraph").alias("element_type"), ustrip("text").alias("content"), level.alias("level"))
    pages = spans.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    scanned = pages.where(F.col("chars") < OCR_PAGE_CHARS).select("doc_id", "page", F.lit(0).cast("long").alias("pos"), F.lit("paragraph").alias("element_type"), F.concat(F.lit("[Page "), F.col("page").cast("string"), F.lit(" — scanned, needs OCR]")).alias("content"), F.lit(0).alias("level"))
    breaks = pages.select("doc_id", "page", F.lit(2**31).cast("long").alias("pos"), F.lit("blank").alias("element_type"), F.lit("").alias("content"), F.lit(0).alias("level"))
    ordered = texts.unionByName(scanned).unionByName(breaks)
    return ordered.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "pos", "content", "level")).cast("long"))


def detect(spans: DataFrame) -> DataFrame:
    """``(doc_id, strategy, confidence)`` from the first pages' font sizes."""
    first = spans.where(F.col("page") <= PDF_SAMPLE_PAGES)
    shape = first.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.percentile(F.col("size").cast("double"), F.lit(0.5)).alias("median"), F.max("size").alias("top"), F.count_distinct(F.round("size", 2)).alias("sizes"))
    layered = (F.col("median") > 0) & (F.col("top") >= HEADING_SIZE * F.col("median")) & (F.col("sizes") >= PDF_MIN_SIZES)
    strategy = F.when((F.col("chars") >= PDF_MIN_CHARS) & layered, "heading_based").otherwise("recursive_fallback")
    return shape.select("doc_id", strategy.alias("strategy"), F.when(F.col("chars") < PDF_MIN_CHARS, "low").otherwise("medium").alias("confidence"))
