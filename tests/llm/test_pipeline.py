"""The pipeline against a plain restatement of each stage over a small corpus."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_operators import plain_components, plain_contaminated

import corpus_pipeline
from docloom.llm import quality


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeiournst") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    bench = [(k, prose(20)) for k in range(4)]
    texts = [prose(r.randint(40, 120)) for _ in range(120)]
    texts += [" ".join("#%$&"[r.randrange(4)] * 3 + word() for _ in range(60)) for _ in range(60)]
    base = texts[3].split()
    for k in range(6):
        copy = list(base)
        copy[5 + 9 * k % len(base)] = word()
        texts.append(" ".join(copy))
    texts += [texts[7]] * 3
    texts += [f"{prose(30)} {t} {prose(30)}" for _, t in bench]
    texts += [f"{prose(30)} a.b@mail.example.com {prose(9)} +1 (555) 123-4567 and 10.0.0.1 {prose(20)}", prose(3000), None, ""]
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows, bench, [(k, int(not 120 <= k < 180), 0) for k in range(180)]


def write(spark, path):
    rows, bench, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, bench, labels


def test_pipeline_equals_restatement(spark, tmp_path):
    rows, bench, labels = write(spark, tmp_path)
    x = quality.statistics(pa.array([t for _, t, *_ in rows], pa.string()))
    of = {k: n for n, (k, *_) in enumerate(rows)}
    use = [(of[k], y) for k, y, _ in labels if zlib.crc32(str(k).encode()) % 4 != 2]
    groups = [x[[n for n, y in use if y == c]] for c in (0, 1)]
    model = quality.Discriminant.fit(np.array([len(g) for g in groups], float), np.array([g.sum(0) for g in groups]), np.array([g.T @ g for g in groups]))
    good = [row for row, s in zip(rows, model.score(x), strict=True) if s >= 0.7]
    assert {k for k, *_ in good} >= set(range(120)) and not {k for k, *_ in good} & set(range(120, 180))
    component = plain_components([r[0] for r in good], [r[1] for r in good])
    single = [r for r in good if component[r[0]][1] == r[0]]
    clean = [r for r in single if not any(plain_contaminated(r[1] or "", t) for _, t in bench)]
    assert len(good) - len(single) >= 9 and len(single) - len(clean) == 4

    def redacted(text):
        out, at = [], 0
        for a, b, kind in brute.pii_base(text):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, (text or "")[at:]])

    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for k, text, *_ in clean:
        ids = np.array([*library.encode(redacted(text), add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for n, at in enumerate([0, *range(first, len(ids), 2048)]):
            want[k, n] = (at, zlib.crc32(ids[at : at + (first if n == 0 else 2048)].tobytes()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids_crc32"]) for r in got} == want
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
