"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of whole texts are transformed to be closer to normal.  Counts, sums
and cross products of each class are aggregated over every labelled row that is
not held out; the driver turns these few numbers into shrunk covariances and
their Cholesky factors.  A score compares the two classes' Mahalanobis
log-densities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import held_out, materialize, small_batches, table
from docloom.llm.vectortext import WordIndex, buffers, mix

STATISTICS = (
    "log_words", "log_mean_length", "length_spread", "upper", "digits", "symbols", "marks", "non_ascii", "sentence_ends",
    "distinct_words", "top_word", "repeated_lines", "line_words", "symbol_words", "short_words", "repeated_pairs",
)
_UPPER, _DIGIT, _LETTER, _SYMBOL, _MARK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True
_MARK[[ord(c) for c in ".,;:'\"()-"]] = True
_SYMBOL[33:127] = ~(_MARK | _DIGIT | _LETTER)[33:127]


#: Weight of the pooled covariance in each class's, and divisor of the log-density difference before the logistic.
SHRINK, TEMPERATURE = 0.3, 3.0
#: Least score of an accepted document.
ACCEPT = 0.7


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; a text without words has its own fixed row of finite values."""
    words = WordIndex(column)
    raw, offsets = buffers(column)
    rows, out = words.rows, np.zeros((words.rows, len(STATISTICS)))
    size = np.diff(offsets)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[raw], dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    n = np.maximum(words.counts, 1)
    length = (words.end - words.start).astype(float)
    by_doc = lambda x: np.bincount(words.doc, x, minlength=rows) if len(words.doc) else np.zeros(rows)
    mean = by_doc(length) / n
    letters = np.maximum(share(_LETTER), 1)
    logit = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5 + 1e-9).clip(0.5))
    hashes = words.hashes()
    last = raw[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    distinct, top, pairs = np.ones(rows), np.ones(rows), np.zeros(rows)
    for d in range(rows):
        own = hashes[words.bounds[d] : words.bounds[d + 1]]
        if len(own):
            _, c = np.unique(own, return_counts=True)
            distinct[d], top[d] = len(c), c.max()
            if len(own) > 2:
                pairs[d] = len(own) - 1 - len(np.unique(own[1:] * np.uint64(31) + mix(own[:-1])))
    breaks = np.flatnonzero(raw == 10)
    n_lines, repeated = np.ones(rows), np.zeros(rows)
    line_of = np.searchsorted(breaks, words.start)  # number of line breaks before each word
    if len(hashes):
        first = np.ones(len(hashes), bool)
        first[1:] = (line_of[1:] != line_of[:-1]) | (words.doc[1:] != words.doc[:-1])
        at = np.flatnonzero(first)
        line_hash = np.add.reduceat(mix(hashes + np.arange(len(hashes), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(hashes)))).astype(np.uint64)), at)
        line_doc = words.doc[at]
        n_lines = np.maximum(np.bincount(line_doc, minlength=rows), 1)
        order = np.lexsort((line_hash, line_doc))
        same = (line_hash[order][1:] == line_hash[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        repeated = np.bincount(line_doc[order][1:][same], minlength=rows)
    cols = {
        "log_words": np.log1p(words.counts), "log_mean_length": np.log1p(mean),
        "length_spread": np.log1p(np.sqrt(np.maximum(by_doc(length**2) / n - mean**2, 0))),
        "upper": logit(share(_UPPER), letters), "digits": logit(share(_DIGIT), np.maximum(size, 1)), "symbols": logit(share(_SYMBOL), np.maximum(size, 1)),
        "marks": logit(share(_MARK), np.maximum(size, 1)), "non_ascii": logit(share(np.arange(256) >= 128), np.maximum(size, 1)),
        "sentence_ends": logit(by_doc((last == 46).astype(float)), n), "distinct_words": np.log(distinct) - np.log(n) * 0.9, "top_word": np.log(top / n),
        "repeated_lines": logit(repeated, n_lines), "line_words": np.log1p(words.counts / n_lines),
        "symbol_words": logit(by_doc(_SYMBOL[last].astype(float)), n), "short_words": logit(by_doc((length <= 3).astype(float)), n), "repeated_pairs": logit(pairs, n),
    }
    for k, name in enumerate(STATISTICS):
        out[:, k] = cols[name]
    return out


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column("text"))
        flat = pa.array(x.ravel(), pa.float64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def with_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)`` of each row; a null text counts as empty."""
    small_batches(documents.sparkSession)
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_map, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, and log weights.

    ``constant`` stands in for every score where one class has no labelled row.
    """

    means: np.ndarray
    factors: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    constant: float | None = None

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK, temperature: float = TEMPERATURE) -> Discriminant:
        """From each class's count, sums and cross products.  Covariances shrink towards the pooled one, and that towards its diagonal."""
        d = sums.shape[1]
        n = np.maximum(counts, 1e-9)
        means = sums / n[:, None]
        scatter = products - means[:, :, None] * means[:, None, :] * counts[:, None, None]
        pooled = scatter.sum(0) / max(counts.sum(), 1.0) + 1e-4 * np.eye(d)
        pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled))
        factors, weights = [], []
        for c in range(2):
            own = (scatter[c] + shrink * 100 * pooled) / (counts[c] + shrink * 100)
            low = np.linalg.cholesky((1 - shrink) * own + shrink * pooled)
            factors.append(np.linalg.inv(low))
            weights.append(np.log((counts[c] + 1) / (counts.sum() + 2)) - np.log(np.diag(low)).sum())
        constant = None if (counts > 0).all() else float((counts[1] + 1) / (counts.sum() + 2))
        return cls(means, np.array(factors), np.array(weights), temperature, constant)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for c in range(2):
            z = (x - self.means[c]) @ self.factors[c].T
            density.append(self.weights[c] - 0.5 * (z**2).sum(1))
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.temperature, -500, 500)))


def fit_quality(statistics_table: DataFrame, labels: DataFrame) -> Discriminant:
    """Aggregate the classes of all labelled rows that are not held out (crc32 of the id modulo 4 is 2).

    A document labelled more than once counts once, with its highest label;
    null ids and labels are left out.  Only one row for each class comes to the
    driver.
    """
    d = len(STATISTICS)
    given = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("y"))
    seen = statistics_table.where(~held_out(F.col("doc_id"), 4)).join(given, "doc_id")
    flat = seen.select("y", *(F.col("x")[k].alias(f"x{k}") for k in range(d)))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = flat.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(f"x{k}").alias(f"s{k}") for k in range(d)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        c = r["y"]
        counts[c], sums[c] = r["n"], [r[f"s{k}"] for k in range(d)]
        for i, j in pairs:
            products[c, i, j] = products[c, j, i] = r[f"p{i}_{j}"]
    return Discriminant.fit(counts, sums, products)


def score_statistics(statistics_table: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` from stored statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return statistics_table.mapInArrow(run, "doc_id long, score double")


def with_quality(documents: DataFrame, model: Discriminant, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All rows and columns with the score beside them, without a shuffle of texts.  A null text scores as an empty one."""
    small_batches(documents.sparkSession)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(statistics(batch.column(names.index(text_col)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*names, score_col])

    return documents.mapInArrow(run, documents.drop(score_col).schema.add(score_col, "double"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``; ids decide what is held out and never enter a score."""
    found = materialize(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit_quality(found, table(spark, sf_dir, "labels"))
    scored = score_statistics(found, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
