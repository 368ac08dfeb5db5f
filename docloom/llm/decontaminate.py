"""Benchmark decontamination by spaced seeds.

Fixed masks read some of the words in a window and skip the others, so that a
substituted word at a skipped place leaves the seed whole.  The executors hash
the test items' seeds into a table; a bitmap of it, of bounded size, goes to the
tasks that read the documents, which keep the seeds that may be in it and lie
as close together as those of a leak must.  These join the table; where a
document and an item meet at one offset often enough, the item is laid over the
document there and compared word by word.  The corpus is read once, whatever the
benchmark's size, and no item comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bitmap import Bitmap
from docloom.llm.common import for_lookup, materialize, small_batches, table
from docloom.llm.vectortext import NO_WORD, WordIndex, mix

#: Two changed words in twelve leave a run of four, or two runs of two around one change; one in five leaves one of
#: the others.  So no leak as defined below escapes all of these.
MASKS = ("1111", "11011", "10111", "11101")
#: A leak is this many words in a row (or the whole of a shorter item) with at least this share equal in place.
WINDOW, SHARE = 12, 0.8
#: Items of fewer words can't be told from ordinary language: they are found where they are a document's whole text.
LEAST_WORDS = 5
#: Bits of the seeds' bitmap at most, as a power of two: 64 MB.
BITMAP_BITS = 29
#: Scripts without spaces: each of their characters is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_ITEMS = "item_id long, n int, hashes binary, seeds array<long>, places array<int>"
_HITS = "hashes binary, seeds array<long>, places array<int>"
FOUND = "item_id long, doc_word int, item_word int, n_words int, n_equal int"


def _words(column: pa.Array) -> WordIndex:
    """Words in lower case, free of ASCII punctuation: neither shouting nor marks hide a leak."""
    column = pc.utf8_lower(column)
    if pc.any(pc.match_substring_regex(column, UNSPACED)).as_py():
        column = pc.replace_substring_regex(column, UNSPACED, r" \1 ")
    return WordIndex(column, NO_WORD)


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out = out * _BASE + hashes[k : k + len(out)]
    return mix(out)


def _whole(hashes: np.ndarray) -> np.ndarray:
    """The one seed of a text below LEAST_WORDS words."""
    return _seeds(hashes, "1" * len(hashes)) ^ np.uint64(len(MASKS))


def _least_equal(n: int) -> int:
    return ceil(SHARE * min(WINDOW, n) - 1e-9)


def least_seeds(n: int) -> int:
    """How many seeds a leak of an item of ``n`` words shares with it at least, by trying all places of the changed words."""
    if n < LEAST_WORDS:
        return 1
    size, counts = min(WINDOW, n), []
    for gone in combinations(range(size), size - _least_equal(n)):
        counts.append(sum(all(at + k not in gone for k, kept in enumerate(m) if kept == "1") for m in MASKS for at in range(size - len(m) + 1)))
    return min(counts)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = _words(batch.column("text"))
        hashes, n, own, seeds, places = words.hashes(), [], [], [], []
        for i in range(batch.num_rows):
            h = hashes[words.bounds[i] : words.bounds[i + 1]]
            each = [_seeds(h, m) ^ np.uint64(k) for k, m in enumerate(MASKS)] if len(h) >= LEAST_WORDS else [_whole(h)] if len(h) else []
            n.append(len(h)), own.append(h.tobytes())
            seeds.append(np.concatenate(each).view(np.int64) if each else []), places.append(np.concatenate([np.arange(len(e)) for e in each]) if each else [])
        columns = [pa.array(n, pa.int32()), pa.array(own, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["item_id", "n", "hashes", "seeds", "places"])


def _reach(counts: np.ndarray, size: int) -> np.ndarray:
    """For each place the most of ``counts`` in any ``size`` places in a row that hold it."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    n = len(counts)
    window = sums[np.minimum(np.arange(n) + size, n)] - sums[:n]
    return np.max([np.concatenate([np.zeros(min(k, n), window.dtype), window[: max(0, n - k)]]) for k in range(size)], axis=0)


def _hits(long: Bitmap, short: Bitmap | None):
    """Documents with seeds that may be an item's: ``short`` has those of items below a window's length."""
    of_long, of_short = least_seeds(WINDOW), min(map(least_seeds, range(LEAST_WORDS, WINDOW)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words(batch.column("text"))
            hashes = words.hashes()
            rows, own, seeds, places = [], [], [], []
            found = np.zeros((2, len(MASKS), len(hashes)), bool)
            every = [_seeds(hashes, m) ^ np.uint64(k) for k, m in enumerate(MASKS)]
            for k, m in enumerate(MASKS):
                inside = words.doc[: len(every[k])] == words.doc[len(m) - 1 :]
                for b, known in enumerate((long, short)):
                    if known is not None:
                        found[b, k, : len(every[k])] = known.may_hold_hash(every[k]) & inside
            kept = found[0] & (_reach(found[0].sum(0), WINDOW) >= of_long)
            if short is not None:
                kept |= found[1] & (_reach(found[1].sum(0), WINDOW) >= of_short)
            some = np.unique(words.doc[kept.any(0)]).tolist() if len(hashes) else []
            some += np.flatnonzero((words.counts > 0) & (words.counts < LEAST_WORDS)).tolist() if short is not None else []
            for d in sorted(set(some)):
                a, b = words.bounds[d], words.bounds[d + 1]
                if b - a < LEAST_WORDS:
                    s, p = _whole(hashes[a:b]), np.zeros(1, np.int64)
                    if not short.may_hold_hash(s)[0]:
                        continue
                else:
                    k, p = np.nonzero(kept[:, a:b])
                    s = np.array([every[i][a + j] for i, j in zip(k, p, strict=True)], np.uint64)
                rows.append(d), own.append(hashes[a:b].tobytes()), seeds.append(s.view(np.int64)), places.append(p)
            columns = [pa.array(own, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *columns], ["key", "hashes", "seeds", "places"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best place of each item in each document, if any is a leak."""
    for batch in batches:
        rows, out = [], []
        for row, (data, tried) in enumerate(zip(batch.column("hashes"), batch.column("tried").to_pylist(), strict=True)):
            own, best = np.frombuffer(data.as_py(), np.uint64), {}
            for t in tried:
                item, start = np.frombuffer(t["item"], np.uint64), t["start"]
                low, high, least = max(start, 0), min(start + len(item), len(own)), min(WINDOW, len(item))
                if high - low < least or (len(item) < LEAST_WORDS and len(own) != len(item)):
                    continue
                equal = own[low:high] == item[low - start : high - start]
                sums = np.concatenate([[0], np.cumsum(equal)])
                good = np.flatnonzero(sums[least:] - sums[:-least] >= (_least_equal(len(item)) if len(item) >= LEAST_WORDS else least))
                if len(good):
                    first, last = int(good[0]), int(good[-1]) + least
                    place = (low + first, low + first - start, last - first, int(sums[last] - sums[first]))
                    if t["item_id"] not in best or (place[3], -place[0], -place[1]) > (best[t["item_id"]][3], -best[t["item_id"]][0], -best[t["item_id"]][1]):
                        best[t["item_id"]] = place
            for item_id, place in sorted(best.items()):
                rows.append(row), out.append((item_id, *place))
        columns = [pa.array([o[c] for o in out], pa.int64() if c == 0 else pa.int32()) for c in range(5)]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), *columns], ["key", "item_id", "doc_word", "item_word", "n_words", "n_equal"])


def _found(texts: DataFrame, kind: str, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, item_id, doc_word, item_word, n_words, n_equal)`` for the rows ``(key, text)``; ``kind`` is the key's type."""
    small_batches(texts.sparkSession)
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = materialize(items.mapInArrow(_item_seeds, _ITEMS).where("n > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    each = items.select("item", "n", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", "n", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    each = materialize(each, "item-seeds")
    short = each.where(F.col("n") < WINDOW).select("seed").distinct()
    known = Bitmap.of_hashes(each.where(F.col("n") >= WINDOW).select("seed").distinct(), "seed", BITMAP_BITS)
    hits = texts.mapInArrow(_hits(known, None if short.isEmpty() else Bitmap.of_hashes(short, "seed", BITMAP_BITS)), f"key {kind}, {_HITS}")
    hits = materialize(hits.withColumn("row", F.monotonically_increasing_id()), "documents-with-seeds")
    asked = hits.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    met = asked.join(each, "seed").groupBy("row", "item", (F.col("at") - F.col("place")).alias("start"), "n").agg(F.count("*").alias("shared"))
    enough = F.element_at(F.array(*(F.lit(least_seeds(n)) for n in range(1, WINDOW + 1))), F.least("n", F.lit(WINDOW)))
    met = materialize(met.where(F.col("shared") >= enough).select("row", "item", "start"), "places-to-compare")
    tried = met.join(items.select("item", "item_id", F.col("hashes").alias("words")), "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "start", F.col("words").alias("item"))).alias("tried"))
    return hits.select("row", "key", "hashes").join(tried, "row").select("key", "hashes", "tried").mapInArrow(_compare, f"key {kind}, {FOUND}")


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, doc_word, item_word, n_words, n_equal)``: each document row and test item that overlap, at the best place.

    Most equal words win, then the earliest place.  Words are runs of ASCII
    letters and digits and of any other characters beyond ASCII, in lower
    case; a character of a script without spaces is a word.  An item below
    LEAST_WORDS words is found where it is a document's whole text.  Null texts
    and ids of items are left out, null texts of documents hold nothing;
    document ids may be null or repeated, and repeated rows are reported each.
    Items of one id are reported once.  Empty tables give no rows.
    """
    given = documents.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _found(given, "long", benchmark, "item_id", "text").withColumnRenamed("key", "doc_id")


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows and columns of the documents that overlap no test item: what is found is a property of the text, by whose digest it is taken out."""
    found = _found(documents.select(_digest(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "binary", benchmark, "item_id", "text")
    gone = materialize(found.select(F.col("key").alias("__gone")).distinct(), "contaminated")
    return documents.join(for_lookup(gone), _digest(text_col) == F.col("__gone"), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
