"""Whole runs: texts, office files and mail to documents and chunks in a store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import enrich
from docloom.functions.mail import clean_body, email_chunks
from docloom.functions.sheets import chunk_sheets
from docloom.functions.text import content_hash, ticket_ids, word_count
from docloom.operators import sync
from docloom.operators.chunk import chunk_elements, chunk_texts, numbered, slide_chunks
from docloom.providers import EmbeddingProvider, embedding
from docloom.sources.office import nested_elements, read_docx, read_pptx, read_xlsx
from docloom.store import Store

DOCUMENTS = "source_id string, content_hash string, title string, file_ext string, doc_type string, sprint string, folder string, labels array<string>, ingested_at timestamp"
CHUNKS = "source_id string, chunk_index int, content string, strategy string, token_count int, ticket_ids array<string>, quarter string, people array<string>, embedding array<double>"
LOG = ("source_id", "action", "reason", "status", "chunks_stored")
#: File extensions that a run of files can read.
TEXTS, OFFICE = ("txt", "md"), ("docx", "pptx", "xlsx")
_OWN_CHUNK = ("source_id", "chunk_index", "content", "strategy")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _replace(store: Store, decided: DataFrame, chunks: DataFrame, provider: EmbeddingProvider | None, gone: DataFrame | None = None) -> DataFrame:
    """Write what a run decided, and return its log.

    ``decided`` has the document's columns with ``action`` and ``reason``;
    ``chunks`` has those of created and updated documents.  Chunks are computed
    once, and flip before their documents: a run that dies between is done
    again by the next, as the documents' hashes are still the old ones.
    """
    stored, old = store.read("documents", DOCUMENTS), store.read("chunks", CHUNKS)
    work = decided.where(F.col("action").isin("create", "update"))
    fresh = work.withColumn("ingested_at", F.current_timestamp()).select(*_columns(DOCUMENTS))
    quarter = fresh.select("source_id", enrich.quarter_of_sprint("sprint").alias("quarter"))
    vector = embedding(provider, "content") if provider else F.lit(None).cast("array<double>")
    rows = chunks.join(quarter, "source_id").withColumns({"token_count": word_count("content"), "ticket_ids": ticket_ids("content"), "embedding": vector})
    kept = old.join(work.select("source_id"), "source_id", "left_anti")
    documents = sync.upsert(stored, fresh, ["source_id"])
    documents = sync.merge_labels(documents, decided.where(F.col("action") == "metadata_updated"))
    if gone is not None:
        documents, kept = (df.join(gone.select("source_id"), "source_id", "left_anti") for df in (documents, kept))
    store.write("chunks", kept.unionByName(rows.withColumn("embedding", F.col("embedding").cast("array<double>")).select(*_columns(CHUNKS))))
    counts = store.read("chunks").join(work.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("chunks_stored"))
    log = decided.select("source_id", "action", "reason").join(counts, "source_id", "left")
    status = F.when(F.col("action").isin("skipped", "metadata_updated"), F.col("action")).when(F.coalesce("chunks_stored", F.lit(0)) == 0, "error").otherwise("success")
    store.write("log", log.withColumns({"status": status, "chunks_stored": F.coalesce("chunks_stored", F.lit(0)).cast("long")}).select(*LOG))
    store.write("documents", documents)
    return store.read("log")


def _ingest(store: Store, given: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], provider: EmbeddingProvider | None, listing_is_complete: bool) -> DataFrame:
    """A run over files ``(source_id, title, folder, seq, content_hash, ...)``."""
    stored = store.read("documents", DOCUMENTS)
    decided = sync.file_actions(given, stored.select("source_id", "content_hash"))
    ext = F.lower(F.element_at(F.split("title", r"\."), -1))
    decided = decided.withColumns({"file_ext": ext, "doc_type": enrich.doc_type("title", ext), "sprint": enrich.sprint_of_filename("title"), "labels": F.lit(None).cast("array<string>")})
    known = F.col("file_ext").isin(*TEXTS, *OFFICE) | F.col("content_hash").isNull()
    decided = decided.withColumn("reason", F.when(F.col("action").isin("create", "update") & ~known, "unsupported").otherwise(F.col("reason")))
    chunks = chunks_of(decided.where(F.col("action").isin("create", "update"))).withColumn("people", F.array().cast("array<string>"))
    return _replace(store, decided, chunks, provider, sync.tombstones(stored, given) if listing_is_complete else None)


def ingest_texts(store: Store, incoming: DataFrame, listing_is_complete: bool = False, provider: EmbeddingProvider | None = None) -> DataFrame:
    """Bring text files ``(source_id, title, text, folder, seq)`` into the store and return the run's log.

    Actions are decided before anything expensive; chunks of new and changed
    documents replace the old ones in one flip.  With a complete listing,
    stored documents that it lacks are deleted with their chunks.
    """
    given = incoming.withColumn("content_hash", content_hash("text"))
    return _ingest(store, given, lambda work: chunk_texts(work, key="source_id").select(*_OWN_CHUNK), provider, listing_is_complete)


def office_chunks(files: DataFrame) -> DataFrame:
    """``(source_id, chunk_index, content, strategy)`` of files ``(source_id, content binary, file_ext)``, each kind by its own reader and chunker.

    A workbook's chunks are numbered over its sheets by name.  A file that can't
    be read, or is of another kind, has none.
    """
    of = lambda *kinds: files.where(F.col("file_ext").isin(*kinds)).select(F.col("source_id").alias("path"), "content")
    texts = chunk_texts(of(*TEXTS).select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text")), key="source_id")
    documents = chunk_elements(nested_elements(read_docx(of("docx")))).withColumnRenamed("doc_id", "source_id")
    slides = slide_chunks(read_pptx(of("pptx")).where("error is null")).withColumnRenamed("doc_id", "source_id").withColumn("strategy", F.lit("slide_based"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_name", "chunk_index")) - 1
    sheets = chunk_sheets(read_xlsx(of("xlsx")).where("error is null")).withColumn("chunk_index", order).withColumnRenamed("doc_id", "source_id")
    return reduce(DataFrame.unionByName, [df.select("source_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content", "strategy") for df in (texts, documents, slides, sheets)])


def ingest_files(store: Store, files: DataFrame, listing_is_complete: bool = False, provider: EmbeddingProvider | None = None) -> DataFrame:
    """Bring files as :func:`docloom.sources.office.list_files` gives them into the store, as :func:`ingest_texts` does with texts.

    Files of other kinds are logged as errors with the reason ``unsupported``,
    files that can't be read or have no chunk as errors without one.
    """
    given = files.select(F.col("path").alias("source_id"), F.col("file_name").alias("title"), "folder", F.unix_micros("modified").alias("seq"), "content_hash", "content")
    return _ingest(store, given, office_chunks, provider, listing_is_complete)


def mail_chunks(threads: DataFrame, is_html: Column | bool = False, names: list[str] | None = None) -> DataFrame:
    """Chunks of assembled threads: ``(thread_id, chunk_index, content, content_hash, ticket_ids, people, sender, subject)``."""
    clean = threads.withColumn("body", clean_body("body", bool(is_html))).withColumn("content_hash", content_hash(F.concat(F.col("thread_id").cast("string"), "body")))
    people = enrich.seed_people("sender", "recipients", names or ["nobody"])
    rows = clean.select("thread_id", "content_hash", "sender", "subject", people.alias("people"), F.posexplode(email_chunks("body", "sender", "subject", "date")).alias("chunk_index", "content"))
    return rows.withColumn("ticket_ids", ticket_ids("content"))


def ingest_mail(store: Store, threads: DataFrame, names: list[str] | None = None, provider: EmbeddingProvider | None = None) -> DataFrame:
    """Bring assembled threads ``(thread_id, subject, sender, recipients, date, labels, body)`` into the store and return the run's log.

    A thread whose labels alone changed keeps its chunks; its labels replace
    the stored ones.
    """
    source = F.col("thread_id").cast("string")
    given = threads.withColumns({"source_id": source, "content_hash": content_hash(F.concat(source, clean_body("body")))})
    decided = sync.email_actions(given, store.read("documents", DOCUMENTS).select("source_id", "content_hash", "labels"))
    none = F.lit(None).cast("string")
    decided = decided.withColumns({"title": F.col("subject"), "file_ext": none, "doc_type": F.lit("email"), "sprint": none, "folder": none, "reason": none})
    work = decided.where(F.col("action").isin("create", "update"))
    people = enrich.seed_people("sender", "recipients", names or ["nobody"])
    clean = work.withColumn("body", clean_body("body")).withColumn("people", people)
    chunks = numbered(clean, email_chunks("body", "sender", "subject", "date"), "source_id", "people", name="content").withColumn("strategy", F.lit("email"))
    return _replace(store, decided, chunks, provider)
