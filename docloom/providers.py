"""Model providers: what a remote service would answer, with deterministic local defaults.

A provider is handed whole Arrow batches and may call any service from there.
Nothing here claims to equal a language model's output.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from functools import cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import EMBED_BATCH, EMBED_TRIES, EMBED_WAIT
from docloom.functions.batches import small_batches

#: Words whose places a worker keeps, and the longest that it keeps; others are hashed anew.
KEPT_WORDS, KEPT_LENGTH = 1 << 17, 64


class EmbeddingProvider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class _Places(dict):
    """The place of each word in a vector; words that count downwards have theirs in a second one after it."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        place = h % self.dimension + (0 if h >> 63 else self.dimension)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = place
        return place


_places = cache(_Places)


class HashedWords:
    """Hashed bag of words, normalised: the local default."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        places, out = _places(self.dimension), []
        for text in texts:
            found = np.array([places[w] for w in re.findall(r"\w+", text.lower())], dtype=np.intp)
            up, down = np.bincount(found, minlength=2 * self.dimension).reshape(2, self.dimension)
            v = (up - down).astype(float)
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).tolist())
        return out


def embed_texts(provider: EmbeddingProvider, texts: list[str], tries: int = EMBED_TRIES, wait: float = EMBED_WAIT) -> list[list[float]]:
    """Vectors of the texts in their order, in batches; a batch that fails is tried again, and at last raises."""
    out: list[list[float]] = []
    for at in range(0, len(texts), EMBED_BATCH):
        batch = [t if t.strip() else "empty document" for t in texts[at : at + EMBED_BATCH]]
        for n in range(tries):
            try:
                out += provider.embed(batch)
                break
            except Exception as e:
                if n + 1 == tries:
                    raise RuntimeError(f"embedding failed after {tries} tries") from e
                time.sleep(wait)
    return out


def embedding(provider: EmbeddingProvider, c: Column | str) -> Column:
    """Column of vectors; call it after filters, which do not pass below it."""
    small_batches()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embed_texts(provider, texts.fillna("").tolist()))

    return run(c)


def parse_json_keys(answer: str, keys: tuple[str, ...]) -> dict[str, list[str]]:
    """Lists under the keys of a JSON answer, fenced or not; anything else is an empty list."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", answer.strip())
    try:
        found = json.loads(bare)
    except json.JSONDecodeError:
        found = {}
    return {k: [str(x) for x in found[k]] if isinstance(found, dict) and isinstance(found.get(k), list) else [] for k in keys}


def extract_metadata(provider: Callable[[str], str], c: Column | str) -> Column:
    """``struct<people, ticket_ids>`` by a provider that answers with JSON; failures give empty lists."""

    @F.pandas_udf("people array<string>, ticket_ids array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append(parse_json_keys(provider(text), ("people", "ticket_ids")))
            except Exception:
                rows.append({"people": [], "ticket_ids": []})
        return pd.DataFrame(rows, columns=["people", "ticket_ids"])

    return run(c)


def render_sheet(rows: list[list[str | None]]) -> str:
    """A sheet as a provider reads it: one line for each row, blank cells empty."""
    return "\n".join(f"Row {k}: " + " | ".join(c or "" for c in row) for k, row in enumerate(rows))


def parse_classification(answer: str) -> tuple[str, dict[int, str]]:
    """Strategy and row groups of a JSON answer, fenced or not; what is not understood is row_based."""
    try:
        found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", answer.strip()))
        strategy = found["strategy"]
        groups = {int(k): str(v) for k, v in (found.get("row_groups") or {}).items() if v is not None}
    except (json.JSONDecodeError, KeyError, TypeError, ValueError, AttributeError):
        return "row_based", {}
    if strategy not in ("single_chunk", "row_based", "group_by_column") or strategy == "group_by_column" and not groups:
        return "row_based", {}
    return strategy, groups if strategy == "group_by_column" else {}


def classify_sheets(provider: Callable[[str, str], str], rows: DataFrame) -> DataFrame:
    """``(doc_id, sheet_name, strategy, row_groups map<int, string>)`` by a provider that is given each sheet's name and rendered rows.

    The local default needs no provider: :func:`docloom.functions.sheets.detect_sheets` and ``forward_fill``.
    """
    types = dict(rows.dtypes)
    whole = rows.groupBy("doc_id", "sheet_name").agg(F.array_sort(F.collect_list(F.struct("row_index", "cells"))).alias("rs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, rs in zip(batch["sheet_name"], batch["rs"], strict=True):
                try:
                    out.append(parse_classification(provider(name, render_sheet([list(r["cells"]) for r in rs]))))
                except Exception:
                    out.append(("row_based", {}))
            yield batch[["doc_id", "sheet_name"]].assign(strategy=[s for s, _ in out], row_groups=[g for _, g in out])

    return whole.mapInPandas(run, f"doc_id {types['doc_id']}, sheet_name string, strategy string, row_groups map<int, string>")


def with_row_groups(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """Add ``group_value`` from a provider's row groups, for ``group_chunks``; rows without one stay null and have no chunk."""
    joined = rows.join(classified.select("doc_id", "sheet_name", "row_groups"), ["doc_id", "sheet_name"])
    return joined.withColumn("group_value", F.try_element_at("row_groups", F.col("row_index").cast("int"))).drop("row_groups")


def template_questions(content: Column | str, heading: Column | str, tickets: Column | str) -> Column:
    """Questions from a chunk's heading and tickets: the local default."""
    head = F.when(F.coalesce(F.trim(heading), F.lit("")) != "", F.array(F.concat(F.lit("What does the section "), heading, F.lit(" say?")))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, F.transform(tickets, lambda t: F.concat(F.lit("What is the state of "), t, F.lit("?"))))


def parse_questions(answer: str) -> list[str]:
    """The strings of an answer that is a JSON array, fenced or not; anything else gives none."""
    try:
        found = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", answer.strip()))
    except json.JSONDecodeError:
        return []
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def asked_questions(provider: Callable[[str], str], content: Column | str) -> Column:
    """Questions by a provider that is given each chunk's content and answers with JSON; failures give none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        rows = []
        for text in texts:
            try:
                rows.append(parse_questions(provider(text)))
            except Exception:
                rows.append([])
        return pd.Series(rows, dtype="object")

    return run(content)


def question_rows(chunks: DataFrame, provider: EmbeddingProvider, key: str = "chunk_id", questions: Callable[[str], str] | None = None) -> DataFrame:
    """``(key, question_index, question, question_embedding)`` of chunks with ``content``, ``section_heading`` and ``ticket_ids``.

    ``questions`` is a provider as of :func:`asked_questions`; without one, questions come from the template.
    """
    found = template_questions("content", "section_heading", "ticket_ids") if questions is None else asked_questions(questions, "content")
    rows = chunks.select(key, found.alias("__q")).select(key, F.posexplode("__q").alias("question_index", "question"))
    return rows.withColumn("question_embedding", embedding(provider, "question"))
