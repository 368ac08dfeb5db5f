from __future__ import annotations

from docloom.operators import retrieve
from docloom.plans.search import search
from docloom.providers import HashedWords

SCHEMA = "source_id string, chunk_index int, content string, strategy string, embedding array<double>"
TEXTS = ["the roof leaks", "the roof is new", "Roof repairs cost much", "payroll in march", "the roof leaks", "", "roof roof roof", None]


def slow_search(rows, question, provider, k, pool=4, weight=0.3):
    q = provider.embed([question])[0]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    words = set(question.lower().split())
    near = []
    for source, index, content, _, v in rows:
        norm = dot(v, v) ** 0.5 * dot(q, q) ** 0.5 if v is not None and len(v) == len(q) else 0
        if norm > 0:
            near.append((-dot(v, q) / norm, source, index, content))
    pooled = sorted(near)[: pool * k]
    scored = [(-((1 - weight) * -s + weight * len(words & set(content.lower().split())) / max(len(words), 1)), source, index) for s, source, index, content in pooled]
    return [(source, index, round(-score, 9)) for score, source, index in sorted(scored)[:k]]


def test_search_equals_brute_force(spark):
    provider = HashedWords(16)
    rows = [(f"s{i % 3}", i, t, "a" if i % 2 else "b", None if t is None else provider.embed([t])[0]) for i, t in enumerate(TEXTS)] + [("z", 0, "the roof leaks", "a", [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, pool in ((1, 1), (3, 1), (3, 2), (20, 4)):
        got = [(r["source_id"], r["chunk_index"], round(r["score"], 9)) for r in search(df, "the roof leaks", provider, k, pool).collect()]
        assert got == slow_search(rows, "the roof leaks", provider, k, pool) and got
    assert {r["chunk_index"] % 2 for r in search(df, "the roof", provider, strategy="b").collect()} == {0}
    assert search(df, "", provider).count() == 0 and search(df.limit(0), "roof", provider).count() == 0


def test_question_counts(spark):
    documents = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    chunks = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x")], "chunk_id int, document_id string, n_questions string")
    questions = spark.createDataFrame([(1, "?"), (1, "?"), (2, "?"), (4, "?"), (None, "?")], "chunk_id int, document_id string")
    assert {tuple(r) for r in retrieve.question_counts(documents, chunks, questions).collect()} == {("a", 3), ("b", 0), ("c", 0)}
