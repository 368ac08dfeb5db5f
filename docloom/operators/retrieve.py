"""Ranking chunks: exact cosines, filters, question index, siblings, re-ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that go to the tasks at once, rows that are compared with them at once, and pairs that are scored exactly at once.
BLOCK, SLICE, SCORED = 1024, 2048, 16384


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, summed in the order of the components."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _cosine(product: Column, norms: Column) -> Column:
    """``product / norms``, null where the norms are zero; both are computed once."""
    return F.transform(F.array(norms), lambda n: F.when(n > 0, product / n))[0]


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null where one is zero."""
    return _cosine(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest rows to one vector, with their columns ``keep``; a filter goes to the scan, and only ``k`` rows of each task move on.

    Rows without a cosine come last and go after the limit: a filter before it would compute each cosine once more.
    """
    given = vectors if where is None else vectors.where(where)
    literal = F.array(*(F.lit(float(x)) for x in query))
    norm = math.sqrt(reduce(lambda s, x: s + x * x, map(float, query), 0.0))  # not sum(), which rounds otherwise than dot()
    near = _cosine(dot(vector_col, literal), F.sqrt(dot(vector_col, vector_col)) * F.lit(norm))
    return given.select(id_col, *keep, near.alias("similarity")).orderBy(F.desc_nulls_last("similarity"), id_col).limit(k).where("similarity is not null")


def _candidates(ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, k: int, margin: float, id_col: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For a block of queries: rows ``(query_id, id, __s)`` that may be among the ``k`` nearest, with each task's best so far as the bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(ids), k), -np.inf)
        for batch in batches:
            batch = batch[batch["__v"].map(len) == vectors.shape[1]]
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                own, v, n = part[id_col].to_numpy(), np.array(part["__v"].tolist(), dtype="float64"), part["__n"].to_numpy()
                near = vectors @ v.T / (norms[:, None] * n)
                near[ids[:, None] == own] = -np.inf
                top = np.concatenate([best, near], axis=1)
                best = np.partition(top, -k, axis=1)[:, -k:]
                q, r = np.nonzero((near > -np.inf) & (near >= best.min(axis=1, keepdims=True) - margin))
                for i in range(0, len(q), SCORED):
                    x, y = q[i : i + SCORED], r[i : i + SCORED]
                    # cumsum adds in the order of the components, as dot() does
                    yield pd.DataFrame({"query_id": ids[x], id_col: own[y], "__s": np.cumsum(vectors[x] * v[y], axis=1)[:, -1] / (n[y] * norms[x])})

    return run


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """The ``k`` nearest rows to each of a stated set of queries ``(query_id, query)``, by comparing every row with every query.

    Queries are gathered on the driver and go to the tasks in blocks of ``BLOCK``, each with a scan of its own, so that a task's memory
    does not grow with their number.  Scores are rounded before ranking, so that ties go by id.  Null ids, and vectors that are null,
    zero, not finite or of another length than the query, are nobody's neighbours.
    """
    finite = "{0} > 0 and {0} < double('infinity') and {1} is not null"
    with_norm = vectors.select(id_col, F.col(vector_col).alias("__v"), F.sqrt(dot(vector_col, vector_col)).alias("__n")).where(finite.format("__n", f"`{id_col}`"))
    asked = queries.select("query_id", "query", F.sqrt(dot("query", "query")).alias("__q")).where(finite.format("__q", "query_id")).toPandas()
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[id_col]
    schema = f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, __s double"
    found = vectors.sparkSession.createDataFrame([], schema)
    for _, same in asked.groupby(asked["query"].map(len)):
        for at in range(0, len(same), BLOCK):
            block = same.iloc[at : at + BLOCK]
            run = _candidates(block["query_id"].to_numpy(), np.array(block["query"].tolist(), dtype="float64"), block["__q"].to_numpy(), k, 2 * 10.0**-digits, id_col)
            found = found.unionAll(with_norm.mapInPandas(run, schema))
    scored = found.select("query_id", id_col, F.round("__s", digits).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "similarity")


def best_question(scores: DataFrame) -> DataFrame:
    """``(chunk_id, similarity)``: the best score of each chunk's questions."""
    return scores.groupBy("chunk_id").agg(F.max("similarity").alias("similarity"))


def question_counts(documents: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``(document_id, n_questions)`` of all documents, from chunks ``(chunk_id, document_id)`` and questions ``(chunk_id)``."""
    of_chunk = questions.groupBy("chunk_id").agg(F.count("*").alias("n_questions"))
    found = chunks.select("chunk_id", "document_id").join(of_chunk, "chunk_id").groupBy("document_id").agg(F.sum("n_questions").alias("n_questions"))
    return documents.select("document_id").join(found, "document_id", "left").fillna(0, ["n_questions"])


def siblings(chunks: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """All chunks of the documents or threads that have a match."""
    return chunks.join(matched.select(key).distinct(), key, "left_semi")


def prefilter(chunks: DataFrame, sender: str | None = None, subject: str | None = None, ticket: str | None = None, **equal: str) -> DataFrame:
    """Chunks by promoted columns; every condition is a plain predicate that the scan can take."""
    for column, value in equal.items():
        chunks = chunks.where(F.col(column) == value)
    if sender:
        chunks = chunks.where(F.contains(F.lower("sender"), F.lit(sender.lower())))
    if subject:
        chunks = chunks.where(F.col("subject").ilike(f"%{subject}%"))
    return chunks.where(F.array_contains("ticket_ids", ticket.upper())) if ticket else chunks


def rerank(candidates: DataFrame, question: str, weight: float = 0.3, content_col: str = "content") -> DataFrame:
    """Add ``score``: similarity and the share of the question's words that the chunk holds (a design of our own)."""
    words = F.array(*(F.lit(w) for w in sorted(set(question.lower().split()))))
    own = F.split(F.lower(content_col), r"\W+")
    overlap = F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1))
    return candidates.withColumn("score", F.col("similarity") * (1 - weight) + overlap * weight)
