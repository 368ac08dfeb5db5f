"""From a question in words to ranked chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import retrieve
from docloom.providers import EmbeddingProvider, embed_texts


def search(chunks: DataFrame, question: str, provider: EmbeddingProvider, k: int = 10, pool: int = 4, weight: float = 0.3, **filters: str) -> DataFrame:
    """The ``k`` chunks ``(source_id, chunk_index, content, similarity, score)`` that answer a question best.

    The question's vector meets the chunks that ``filters`` leave (as of
    :func:`retrieve.prefilter`); the ``pool * k`` nearest are ranked again by
    their words.  These keep their contents from the first, so that chunks are
    made and embedded in one pass.  Ties go by source and index;
    chunks without a vector of the question's length take no part, and a
    question without words finds nothing.
    """
    asked = chunks.where(F.lit(bool(question.strip())))
    given = retrieve.prefilter(asked, **filters).withColumn("__id", F.struct("source_id", "chunk_index"))
    near = retrieve.top_k(given, embed_texts(provider, [question])[0], pool * k, "__id", keep=("content",))
    ranked = retrieve.rerank(near, question, weight)
    best = ranked.select("__id.source_id", "__id.chunk_index", "content", "similarity", "score")
    return best.orderBy(F.desc("score"), "source_id", "chunk_index").limit(k)
