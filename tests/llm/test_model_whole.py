"""The language model learns from every training text in every round."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from test_operators import docs, words

from docloom.llm import hmm, language_model


def test_every_round_sees_all_training_texts(spark, monkeypatch):
    made, shares, trained = [], [], language_model._baum_welch
    monkeypatch.setattr(language_model, "_baum_welch", lambda *a: shares.append(a[2]) or made.append(trained(*a)) or made[-1])
    draw = np.random.default_rng(7)
    texts = [" ".join(f"{'abcd'[k % 4]}{int(w)}" for w in draw.integers(0, 12, draw.integers(3, 25))) for k in range(4_000)]
    train = [words(t) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    assert language_model.language_model_scores(docs(spark, texts)).count() == len(texts)
    sequences = [np.array([order[w] for w in t] + [language_model._END], np.uint16) for t in train]
    expected = hmm.first_guess(sequences, shares[0], language_model.STATES, language_model.ROUNDS)
    for part in ("start", "step", "emit"):
        assert np.allclose(getattr(made[-1], part), getattr(expected, part), atol=1e-3), part


def test_nothing_to_learn_from(spark):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string")
    got = language_model.language_model_scores(rows).collect()
    assert len(got) == len(held) and all(r["held_out"] and r["n_known"] == 0 and r["score"] < 0 for r in got)
