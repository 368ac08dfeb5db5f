"""Queries over whole texts and whole tables: what stands late in them is not lost."""

from __future__ import annotations

import numpy as np
import pytest

from docloom.operators import retrieve
from docloom.plans.catalog import QUERIES
from docloom.providers import HashedWords, question_rows

LONG = "word " * 30 + "late TECH-99 and OPS-42, XY-7 \nlast line"


@pytest.fixture
def one_document(spark, tmp_path):
    spark.createDataFrame([(6, LONG)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_late_tickets(spark, one_document):
    run = lambda name: QUERIES[name](spark, one_document)
    assert run("extract_tickets").first()["tickets"] == "TECH-6,SPRINT-8,V2-PLAN-001,OPS-7,TECH-99,OPS-42,XY-7"
    assert run("filter_tickets").first()["tickets"] == "TECH-6,OPS-7,TECH-99,OPS-42"
    assert {f"What is the state of {t}?" for t in ("TECH-99", "OPS-42", "XY-7")} <= {r["question"] for r in run("chunk_questions").collect()}


def test_blocks_and_sections_are_whole(spark, one_document):
    first = "### Ticket 1: TECH-6\nTier: 1\n" + LONG
    blocks = [tuple(r) for r in QUERIES["split_ticket_blocks"](spark, one_document).select("block", "content", "ticket", "tier").orderBy("block").collect()]
    assert blocks == [(0, first, "TECH-6", 1), (1, "## TICKET 2\nOPS-6\n- end", "OPS-6", 2)]
    assert QUERIES["section_between_markers"](spark, one_document).first()["section"] == first
    threads = [r["content"] for r in QUERIES["email_thread_blocks"](spark, one_document).orderBy("block").collect()]
    assert threads == [f"## THREAD — {k}\n{LONG}" for k in range(2)]


def test_every_stated_query_is_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 3)
    monkeypatch.setattr(retrieve, "SLICE", 7)
    vectors = np.random.default_rng(1).integers(-3, 4, (130, 4)).astype(float)
    vectors[[7, 40]], vectors[50:65] = 0, vectors[20]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    spark.createDataFrame([*rows, (200, None), (220, [1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = []
    for q in range(0, 130, 20):
        sims = [(i, round(float(v @ vectors[q] / (np.linalg.norm(v) * np.linalg.norm(vectors[q]))), 6)) for i, v in enumerate(vectors) if i != q and v.any() and vectors[q].any()]
        expected += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(sims, key=lambda x: (-x[1], x[0]))[:10])]
    got = [tuple(r) for r in QUERIES["topk_per_query"](spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [r[:3] for r in expected] and [r[3] for r in got] == pytest.approx([r[3] for r in expected], abs=2e-6)


def test_questions_by_a_provider(spark):
    answers = {"a": '```json\n["Who?", "When?"]\n```', "b": '[3, "Why?"]', "c": '{"questions": ["Who?"]}', "d": "no json"}
    df = spark.createDataFrame([(c, c, "H", ["TECH-1"]) for c in "abcde"], "chunk_id string, content string, section_heading string, ticket_ids array<string>")
    got = question_rows(df, HashedWords(8), questions=lambda text: answers[text]).orderBy("chunk_id", "question_index").collect()
    assert [(r["chunk_id"], r["question_index"], r["question"], len(r["question_embedding"])) for r in got] == [("a", 0, "Who?", 8), ("a", 1, "When?", 8), ("b", 0, "Why?", 8)]


def test_all_documents_are_merged_and_looked_up(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en") for i in range(6)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = {r["source_id"]: (r["labels"], r["source_type"]) for r in QUERIES["label_only_update"](spark, str(tmp_path)).collect()}
    assert labels == {f"s{i}": ("en,INBOX" if i % 2 else "STARRED", "google_drive" if i else "gmail") for i in range(6)}
    assert sorted(r["source_id"] for r in QUERIES["exists_by_hash"](spark, str(tmp_path)).collect()) == ["s1", "s3", "s5"]
