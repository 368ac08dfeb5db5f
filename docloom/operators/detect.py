"""How a document is organised, from rows of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import BLANK_RATIO, BOLD_TITLE_MAX, MIN_BLANKS, MIN_HEADINGS
from docloom.functions.text import ustrip


def detect_docx(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, strategy, confidence)`` from ``(doc_id, style, text, bold)``; one pre-aggregated pass."""
    blank = ustrip(F.coalesce("text", F.lit(""))) == ""
    shape = paragraphs.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.startswith("style", F.lit("Heading"))).alias("headings"),
        F.count_if(~blank & F.col("bold") & (F.length("text") <= BOLD_TITLE_MAX)).alias("bold"), F.count_if(blank).alias("blanks"),
    )
    by_blank = (F.col("blanks") >= MIN_BLANKS) & (F.col("blanks") / F.col("n") > BLANK_RATIO)
    strategy = F.when(F.col("headings") >= MIN_HEADINGS, "heading_based").when(F.col("bold") >= 2, "bold_title_based").when(by_blank, "blank_line_based").otherwise("recursive_fallback")
    confidence = F.when(strategy == "heading_based", "high").when(strategy == "recursive_fallback", "low").otherwise("medium")
    return shape.select("doc_id", strategy.alias("strategy"), confidence.alias("confidence"))
