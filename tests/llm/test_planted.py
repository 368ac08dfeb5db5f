"""Planted personal data and credentials: what the methods add to the base patterns, by precision and recall."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import pii, secrets, spans

PERSONAL = [
    "You can reach Ana under ana.silva (at) posteo (dot) de until Friday", "our mailbox is support [at] widgets [dot] org now", "Jo's e-mail: jo.k{at}home{dot}net",
    "please call (555) 867-5309 after six", "his mobile is 0171 5550123, ring twice", "hotline: 555-867-5309", "fax 030/5550199", "the login came from 10[.]0[.]31[.]7 at night",
    "ping host 192(.)168(.)0(.)17 first", "client ip fe80:0:0:0:1c2:7ff:fe3a:9b1 connected", "charged to visa 4111.1111.1111.1111 yesterday", "credit card 5500_0000_0000_0004 was used",
]
HARMLESS = [
    "order 555-867-53091 was shipped", "see pages 120-1345 of the report", "isbn 978-3-16-148410", "meet me at noon.sharp or later", "we met at dawn.then left", "total 1200 3400 560000 units",
    "serial 4111.1111.1111.1112 on the lid", "dated 2020-10-12-1234 in the log", "a row of 1 2 3 4", "invoice 120-33-4500 is due", "version 300-12-4411 came out", "nothing here at all",
]


def test_disguised_personal_data(spark):
    """Each text holds one thing, or none: the span must cover it, and harmless texts must stay whole."""
    df = spark.createDataFrame(list(enumerate(PERSONAL + HARMLESS)), "doc_id long, text string")
    got = {r["doc_id"]: [s for s in r["spans"] if s not in r["base_spans"]] for r in pii.pii_spans(df).collect()}
    caught = sum(bool(got[k]) for k in range(len(PERSONAL)))
    wrong = sum(bool(got[k]) for k in range(len(PERSONAL), len(got)))
    assert caught / len(PERSONAL) >= 0.8 and caught / (caught + wrong) >= 0.9, [t for k, t in enumerate(PERSONAL + HARMLESS) if bool(got[k]) != (k < len(PERSONAL))]


def test_thresholds_come_from_calibration(spark):
    _, limits = pii.fitted(spark)
    assert len({round(v, 6) for v in limits.values()}) > 1 and all(v != 0.5 for v in limits.values())
    score, right = np.array([0.9, 0.8, 0.8, 0.7, 0.2]), np.array([1.0, 1.0, 1.0, 1.0, 0.0])
    assert pii.threshold(score, right) == 0.7 and pii.threshold(score, 1 - right) == 1.1 and pii.threshold(score[:0], right[:0]) == 1.1


def chosen(given):
    """Greedy selection, restated."""
    out = [s for s in given if s[2] == 2]
    for s in sorted((s for s in given if s[2] < 2), key=lambda s: (-s[2], s[0])):
        if not any(a[0] < s[1] and a[1] > s[0] for a in out):
            out.append(s)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_equals_greedy(spark, seed):
    r = random.Random(seed)
    rows = [[(0, 10, 0.9), (8, 20, 0.8), (18, 30, 0.7)], [(0, 10, 0.7), (8, 20, 0.8), (18, 30, 0.9)], []]
    rows += [sorted((a, a + r.randint(1, 9), r.choice([2.0, round(r.random(), 3)])) for a in r.sample(range(60), r.randint(1, 25))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, s array<struct<start: bigint, end: bigint, score: double>>")
    for row in df.withColumn("c", F.expr(spans.best_of_overlapping("s"))).collect():
        assert sorted(map(tuple, row["c"])) == chosen(rows[row["k"]])


def test_credentials_by_owner(spark):
    """Copied examples of many owners against what one owner holds in several repositories of their own."""
    r = random.Random(3)
    fresh = lambda: r.choice(["ghp_", "sk_live_"]) + "".join(r.choice("aBcDeFgHiJkLmNoP0123456789") for _ in range(36))
    own, copied, rows = [fresh() for _ in range(30)], [fresh() for _ in range(10)], []
    for k, v in enumerate(own):
        rows += [(f"owner{k}/r{j}", f"owner{k}", f"set {v} here", 1) for j in range(r.randint(1, 2))]
    for v in copied:
        rows += [(f"owner{j}/r0", f"owner{j}", f"like {v} there", 0) for j in range(4)]
    rows += [(f"owner{k}/r0", f"owner{k}", f"use ghp_{'example' * 6} or {'x' * 40}", 0) for k in range(3)]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "doc_id long, repo string, owner string, text string, label int")
    found = {x["doc_id"]: x["spans"] for x in secrets.secret_spans(df, repo_col="repo", owner_col="owner").collect()}
    caught = [(bool(found[k]), row[3]) for k, row in enumerate(rows)]
    assert all(hit == bool(live) for hit, live in caught)
    assert {s["n_owners"] for k, row in enumerate(rows) if row[3] for s in found[k]} == {1} and {s["n_repos"] for k, row in enumerate(rows) if row[3] for s in found[k]} == {1, 2}
    assert all(brute.joined([(s["start"], s["end"], "service") for s in found[k]]) == f"service:4:{4 + len(row[2].split()[1])}" for k, row in enumerate(rows) if row[3])
