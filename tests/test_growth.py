"""What must not grow with the input: passes over it, and what a worker or task holds at once."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from docloom.functions import sheets
from docloom.plans import recipes
from docloom.plans.catalog import QUERIES
from docloom.providers import HashedWords

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write_documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def lowers_batches(spark, name, folder):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "10000")
    try:
        QUERIES[name](spark, folder)
        return int(spark.conf.get(BATCH)) <= 256
    finally:
        spark.conf.set(BATCH, before)


def test_search_chunks_makes_chunks_once(spark, tmp_path):
    folder = write_documents(spark, tmp_path, ["what does the report say", "nothing", "", None, "the report. " * 200])
    found = QUERIES["search_chunks"](spark, folder)
    assert [r["source_id"] for r in found.limit(1).collect()] == [0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert lowers_batches(spark, "search_chunks", folder)


def test_hashed_words_equal_plain_ones(monkeypatch):
    monkeypatch.setattr("docloom.providers.KEPT_WORDS", 3)
    texts = ["A b a b c", "", "!", "ä Ä word " + "long" * 40, " ".join(f"w{i % 7}" for i in range(50))]
    for dimension in (1, 5, 64):
        for text, got in zip(texts, HashedWords(dimension).embed(texts), strict=True):
            v = np.zeros(dimension)
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            assert got == (v / np.linalg.norm(v) if v.any() else v).tolist()


def test_chunk_router_sends_small_batches(spark, tmp_path):
    assert lowers_batches(spark, "chunk_router", write_documents(spark, tmp_path, ["one line"]))


def test_packing_sends_small_batches(spark, tmp_path):
    folder = write_documents(spark, tmp_path, ["one line"])
    assert all(lowers_batches(spark, name, folder) for name in ("pack_words", "pack_sentences", "chunk_recursive"))


def plain_sheet(name, rows):
    """The chunks of one sheet, whose rows are its cells in order, or null cells, the first being the header."""
    full = lambda c: c is not None and c.strip() != ""
    filled = [(i, r[0]) for i, r in enumerate(rows) if any(full(c) for c in r)]
    head, values = (filled[0][1] or "") if filled else "", [v for _, v in filled[1:] if v is not None]
    if len(rows) == 1:
        long = [c.strip() for c in rows[0] if c is not None and len(c.strip()) > 100]
        return [(f"[{name}]\n" + "\n".join(long), "single_chunk")] if long else []
    label = lambda r: " | ".join(f"{h or f'Column{i}'}: {r[i]}" for i, h in enumerate(rows[0]) if i < len(r) and full(r[i]))
    if len(filled) <= 5:
        lines = [" | ".join(c for c in r if full(c)) for r in rows[1:]]
        return [("\n".join([f"[{name}]", *(x for x in lines if x)]), "single_chunk")]
    kinds = len(set(values))
    if head.strip() and 2 <= kinds <= 8 and len(values) > 1.5 * kinds and len(values) >= 0.5 * (len(filled) - 1):
        groups, group = {}, None
        for r in rows[1:]:
            group = r[0] if full(r[0]) else group
            if group is not None:
                groups.setdefault(group, []).append(label(r))
        return [(f"[{name}] {g}\n" + "\n".join(x for x in lines if x), "group_by_column") for g, lines in groups.items()]
    return [(f"[{name}]\n{label(r)}", "row_based") for r in rows[1:] if label(r)]


def test_chunk_sheets_in_blocks(spark, monkeypatch):
    """A sheet's rows meet in blocks: groups are filled, numbered and put together across them."""
    monkeypatch.setattr(sheets, "BLOCK", 3)
    draw, made = random.Random(5), {}
    for k in range(40):
        kinds = draw.choice([["a", "b", ""], ["a", None, " ", "b", "c"], [f"v{i}" for i in range(60)], ["", None], ["x"]])
        rows = [[draw.choice(kinds), draw.choice(["y", "z", "", None, " "]), *draw.choice([[], ["extra"]])] for _ in range(draw.choice([0, 2, 5, 9, 25, 40]))]
        made[f"s{k}"] = [[draw.choice(["Head", "Head", "", " "]), draw.choice(["Two", "", None, "long " * 30])], *rows]
    data = [("d", name, i, r) for name, rows in made.items() for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id string, sheet_name string, row_index long, cells array<string>").repartition(5)
    got = sorted((r["sheet_name"], r["chunk_index"], r["content"], r["strategy"]) for r in sheets.chunk_sheets(df).collect())
    expected = sorted((name, i, *c) for name, rows in made.items() for i, c in enumerate(plain_sheet(name, rows)))
    assert got == expected and {c[3] for c in got} == {"single_chunk", "row_based", "group_by_column"}


def test_sheet_rows_are_numbered_in_ranges(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k * k, k % 50, "LOW", "O") for k in range(400)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"p{k}", "b", 1) for k in range(30)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, f"n{k}", k % 2) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(recipes, "KEYS", 100)
    got = {(r["doc_id"], r["row_index"]): r["cells"][1] for r in recipes.sheets(spark, str(tmp_path)).where("sheet_name = 'Orders' and row_index > 0").collect()}
    by_sheet = {}
    for k in range(400):
        by_sheet.setdefault(k % 50 % 40, []).append(str(k * k))
    assert got == {(d, i + 1): key for d, keys in by_sheet.items() for i, key in enumerate(keys)}
