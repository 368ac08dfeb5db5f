"""Scoring by a hidden Markov language model.

Words are counted over all training texts.  The most frequent words are classes
of their own; the others fall into classes by their endings, within which a
word has its share of the class's counts.  Latent states start from these counts
and are trained by Baum-Welch rounds, each over all training texts, whose
expected counts are aggregated over all partitions; a text's score is the exact
likelihood by the scaled forward recursion.  Only bounded tables (the frequent
words, the classes' parameters) are broadcast: all other words meet their counts
in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import held_out, materialize, small_batches, table
from docloom.llm.hmm import Counts, Model, drawn, expect, log_likelihoods

#: Most words whose counts every task holds, and those of them that are classes of their own.
HEAD_WORDS, OWN_CLASSES = 65_536, 16_384
ENDINGS = 512
#: Latent states, and Baum-Welch rounds, each over all training texts.
STATES, ROUNDS = 8, 14
#: Training cuts longer texts into segments of so many tokens; scoring never does.
SEGMENT = 1_024
#: Tokens that a task handles side by side.
SIDE_BY_SIDE = 4_000_000
_END = OWN_CLASSES + ENDINGS
CLASSES = _END + 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case."""
    return text.translate(_LOWER).split()


def ending_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[-2:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").cast(pa.binary()):
            counts.update(words(text.as_py()))
        if len(counts) > 1_000_000:
            yield rows(counts)
            counts = Counter()
    yield rows(counts)


def _encode(head: Callable[[], tuple[dict[bytes, int], np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, classes = head()
        get = known.get
        for batch in batches:
            n_tokens, n_head, head_log, inner_log, sequences, rare, rare_n = ([] for _ in range(7))
            for text in batch.column("text").cast(pa.binary()):
                own = words(text.as_py())
                ids = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
                there = ids[ids >= 0]
                seq = np.empty(len(own) + 1, np.uint16)
                seq[:-1] = classes[ids]
                seq[-1] = _END
                unknown = np.flatnonzero(ids < 0)
                others = [own[i] for i in unknown]
                seq[unknown] = [ending_class(w) for w in others]
                counted = Counter(others)
                n_tokens.append(len(seq)), n_head.append(len(there)), head_log.append(float(logs[there].sum()))
                inner_log.append(float(logs[there[there >= OWN_CLASSES]].sum())), sequences.append(seq.tobytes())
                rare.append(list(counted.keys())), rare_n.append(list(counted.values()))
            columns = [pa.array(n_tokens, pa.int64()), pa.array(n_head, pa.int64()), pa.array(head_log, pa.float64()), pa.array(inner_log, pa.float64())]
            columns += [pa.array(sequences, pa.binary()), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], _ENCODED_NAMES)

    return run


_ENCODED_NAMES = ["doc_id", "held_out", "n_tokens", "n_head", "head_log", "inner_log", "classes", "rare", "rare_n"]
_ENCODED = "doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, inner_log double, classes binary, rare array<binary>, rare_n array<int>"


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list]]:
    """Sequences and their row numbers, as many at a time as are handled side by side."""
    sequences, rows, tokens = [], [], 0
    for batch in batches:
        for row, data in zip(batch.column("row").to_pylist(), batch.column("classes"), strict=True):
            sequences.append(np.frombuffer(data.as_py(), np.uint16))
            rows.append(row)
            tokens += len(sequences[-1])
            if tokens >= SIDE_BY_SIDE:
                yield sequences, rows
                sequences, rows, tokens = [], [], 0
    if sequences:
        yield sequences, rows


def _segments(sequences: list[np.ndarray]) -> list[np.ndarray]:
    return [s[at : at + SEGMENT] for s in sequences for at in range(0, len(s), SEGMENT)]


def _side_by_side(sequences: list[np.ndarray], tokens: int = 400_000) -> Iterator[list[np.ndarray]]:
    """Groups of similar length, so that few of a group run on alone."""
    group, size = [], 0
    for s in sorted(sequences, key=len):
        if group and size + len(s) > tokens:
            yield group
            group, size = [], 0
        group.append(s)
        size += len(s)
    if group:
        yield group


def _baum_welch(encoded: DataFrame, model: Model, share: np.ndarray) -> Model:
    """One round over all training texts: partial counts of each partition are summed by class."""
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_seen = Counts.zero(states, len(share)), False
        for sequences, _ in _portions(batches):
            any_seen = True
            for group in _side_by_side(_segments(sequences), 800_000):
                expect(model, group, counts)
        if any_seen:
            rows = np.vstack([counts.emit, counts.step, counts.start[None, :]])
            seen = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(rows[seen, s]) for s in range(states))], ["k", *(f"s{s}" for s in range(states))])

    parts = encoded.where("not held_out").select("row", "classes").mapInArrow(run, "k int, " + ", ".join(f"s{s} double" for s in range(states)))
    total = np.zeros((len(share) + states + 1, states))
    for r in parts.groupBy("k").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toArrow().to_pylist():
        total[r["k"]] = [r[f"s{s}"] for s in range(states)]
    return Counts(total[-1], total[len(share) : -1], total[: len(share)]).model(share)


def _head(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, most frequent first, ties by word: all whose count lies in the upper bins that hold at most HEAD_WORDS words."""
    place = F.floor(F.log2("c") * 64).cast("int")
    held, least = 0, None
    for r in vocabulary.groupBy(place.alias("k")).count().orderBy(F.desc("k")).collect():  # a row for each of a few thousand bins at most
        held += r["count"]
        if held > HEAD_WORDS:
            break
        least = r["k"]
    if least is None:
        return [], np.zeros(0, np.int64)
    rows = sorted((-r["c"], bytes(r["word"])) for r in vocabulary.where(place >= least).collect())
    return [w for _, w in rows], -np.array([c for c, _ in rows], np.int64)


def language_model_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of each input row, in log10.

    Texts whose crc32 of the id as text has remainder 2 modulo 7 are held out
    of all learning (a null id counts as empty text, and repeated rows count
    each).  A null text counts as empty: its one token is the end.  ``score``
    is a probability over all texts of known words and one unknown word for
    each ending; it differs from ``base_score`` by what the states know of
    order and topic.  Ties among equally frequent words go by the word.  With
    no training text every known count is 0.  An empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("held_out", held_out(F.col("doc_id"), 7))
    counted = given.where("not held_out").select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    vocabulary = materialize(counted, "vocabulary")
    head_words, head_counts = _head(vocabulary)
    classes = np.array([k if k < OWN_CLASSES else ending_class(w) for k, w in enumerate(head_words)] + [0], np.uint16)
    shared = spark.sparkContext.broadcast((head_words, np.log10(head_counts + 1.0), classes))

    def head_table() -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
        listed, logs, of = shared.value
        return {w: k for k, w in enumerate(listed)}, logs, of

    encoded = materialize(given.mapInArrow(_encode(head_table), _ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    n_texts = encoded.where("not held_out").count()
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    n_train, n_distinct = total + n_texts, distinct + (n_texts > 0)
    ending = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(ENDINGS)) + OWN_CLASSES
    own_least = spark.createDataFrame([(w,) for w in head_words[:OWN_CLASSES]], "word binary")
    by_ending = vocabulary.join(F.broadcast(own_least), "word", "left_anti").groupBy(ending.cast("int").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    class_counts, class_mass = np.zeros(CLASSES), np.ones(CLASSES)
    class_counts[: min(OWN_CLASSES, len(head_counts))] = head_counts[:OWN_CLASSES]
    for r in by_ending:
        class_counts[r["k"]], class_mass[r["k"]] = r["c"], r["c"] + r["v"] + 1.0
    class_counts[_END] = n_texts
    share = (class_counts + 0.1) / (class_counts.sum() + 0.1 * CLASSES)
    own_unused = np.arange(len(head_words), OWN_CLASSES)  # a small vocabulary leaves these classes without a word
    share[own_unused] = 0.0
    share /= share.sum()
    model = drawn(share, STATES)
    for _ in range(ROUNDS if n_texts else 1):  # without a training text one round leaves the plain shares
        model = _baum_welch(encoded, model, share)
    inner = np.where((np.arange(CLASSES) >= OWN_CLASSES) & (np.arange(CLASSES) < _END), np.log10(class_mass), 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sequences, rows in _portions(batches):
            place = {id(s): n for n, s in enumerate(sequences)}
            got = np.empty(len(sequences))
            for group in _side_by_side(sequences):
                for s, value in zip(group, log_likelihoods(model, group), strict=True):
                    got[place[id(s)]] = value / np.log(10) - inner[s].sum()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(got)], ["row", "class_log"])

    scored = encoded.select("row", "classes").mapInArrow(score, "row long, class_log double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    rare = rare.join(vocabulary, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_log"), F.sum("n").alias("n_rare"))
    rows = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_head", "head_log", "inner_log").join(scored, "row").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("head_log") + rare_log + F.lit(float(np.log10(n_texts + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_distinct + 1.0)))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(n_texts > 0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("class_log") + F.col("inner_log") + rare_log).alias("score"),
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
