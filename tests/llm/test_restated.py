"""Scores of the trained models against plain restatements of their formulas."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from test_operators import docs, words

from docloom.llm import language_model, quality


def test_discriminant_equals_plain_densities():
    """Regularised covariances from the rows themselves, and log-densities by solving, not by cached factors."""
    draw = np.random.default_rng(4)
    groups = [draw.standard_normal((n, 5)) @ draw.standard_normal((5, 5)) + c for c, n in ((0, 40), (1, 70))]
    model = quality.Discriminant.fit(np.array([len(g) for g in groups], float), np.array([g.sum(0) for g in groups]), np.array([g.T @ g for g in groups]))
    shrink, total = quality.SHRINK, sum(map(len, groups))
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups) / total + 1e-4 * np.eye(5)
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled))
    x, density = draw.standard_normal((30, 5)) * 2, []
    for g in groups:
        own = (np.cov(g.T, bias=True) * len(g) + shrink * 100 * pooled) / (len(g) + shrink * 100)
        cov, d = (1 - shrink) * own + shrink * pooled, x - g.mean(0)
        density.append(math.log((len(g) + 1) / (total + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))
    assert np.allclose(model.score(x), 1 / (1 + np.exp((density[0] - density[1]) / quality.TEMPERATURE)), atol=1e-9)


def test_language_model_scores_equal_a_plain_recursion(spark, monkeypatch):
    """All words are classes of their own here, so that a text's score is the forward probability of its words and the end."""
    made, trained = [], language_model._baum_welch
    monkeypatch.setattr(language_model, "_baum_welch", lambda *a: made.append(trained(*a)) or made[-1])
    draw = np.random.default_rng(2)
    texts = [" ".join(f"w{int(k)}" for k in draw.integers(0, 30, draw.integers(0, 40))) for _ in range(60)] + ["never seen words", None]
    counts = Counter(w for k, t in enumerate(texts) for w in words(t) if zlib.crc32(str(k).encode()) % 7 != 2)
    order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w)))}
    got = {r["doc_id"]: r["score"] for r in language_model.language_model_scores(docs(spark, texts)).collect()}
    model = made[-1]
    for k, t in enumerate(texts):
        seen = [order.get(w, language_model.ending_class(w)) for w in words(t)] + [language_model._END]
        now, total = None, 0.0
        for c in seen:
            now = model.start * model.emit[c] if now is None else (now @ model.step) * model.emit[c]
            total, now = total + math.log10(now.sum()), now / now.sum()
        assert math.isclose(got[k], total, rel_tol=1e-9), t
