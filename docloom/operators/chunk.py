"""Chunks of documents: one projection for each strategy, numbered within the document, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import elements as E
from docloom.functions.packing import recursive_chunks
from docloom.functions.text import word_count


def numbered(df: DataFrame, array: Column | str, *keys: Column | str, name: str = "c", index: str = "chunk_index") -> DataFrame:
    """Rows of an array with their index.

    The outer form, as for the other one Spark infers a filter on the array's
    size, which would compute the whole array once more.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(index, name)).where(F.col(index).isNotNull())


def explode_chunks(df: DataFrame, chunks: str, *keys: str) -> DataFrame:
    """Rows of an array of chunk structs with their ``chunk_index``."""
    return numbered(df, chunks, *keys).select(*keys, "chunk_index", "c.*")


def chunk_texts(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Parse, detect and chunk plain texts by the detected strategy: ``(key, chunk_index, content, strategy, token_count)``.

    One pass over the texts; only those without structure have anything for the Arrow function that splits recursively.
    """
    return chunk_elements(documents.select(key, F.expr(E.parse_text(text)).alias("els")), key)


def chunk_elements(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Detect and chunk arrays of elements ``(key, els)``, as :func:`chunk_texts` does; bold titles count where there are no headings."""
    parsed = parsed.withColumn("found", F.expr(E.detect_text("els")))
    bold = F.expr("size(filter(els, e -> e.type = 'bold_title')) >= 2")
    strategy = F.when((F.col("found.strategy") != "heading_based") & bold, "bold_title_based").otherwise(F.col("found.strategy"))
    content = lambda e: F.transform(F.expr(e), lambda c: c["content"])
    joined = F.array_join(F.expr("transform(filter(els, e -> e.type <> 'blank' and e.content <> ''), e -> e.content)"), "\n\n")
    native = F.when(strategy == "heading_based", content(E.heading_chunks("els"))).when(strategy == "bold_title_based", content(E.heading_chunks("els", "bold_title"))).when(strategy == "blank_line_based", content(E.blank_line_chunks("els")))
    split = parsed.select(key, strategy.alias("strategy"), native.alias("native"), F.when(strategy == "recursive_fallback", joined).alias("joined"))
    split = split.withColumn("parts", recursive_chunks("joined"))
    rows = numbered(split, F.coalesce("native", "parts"), key, "strategy", name="content")
    return rows.select(key, "chunk_index", "content", "strategy", word_count("content").alias("token_count"))


def slide_chunks(slides: DataFrame, key: str = "doc_id") -> DataFrame:
    """One chunk for each slide, the empty ones included; ``slide_number`` counts from 1."""
    return slides.select(key, (F.col("slide_number") - 1).alias("chunk_index"), "slide_number", F.coalesce("content", F.lit("")).alias("content"))


def stored_columns(chunks: DataFrame) -> DataFrame:
    """The columns that a store derives on insert, from chunk and document metadata side by side."""
    from docloom.functions.text import first_filled

    return chunks.withColumns(
        {
            "chunk_type": F.coalesce("element_type", F.lit("standard")), "token_count": word_count("content"),
            "document_title": first_filled("file_name", "title"), "author": first_filled("owner", "sender"),
        }
    )
