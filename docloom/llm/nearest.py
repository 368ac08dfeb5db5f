"""Approximate nearest neighbours by an inverted multi-index.

The halves of the normalised vectors are quantised separately; a pair of
centroids is a cell.  A query visits cells in the order of summed distances,
with a heap over the two sorted lists, until it has met so many entries as
calibration found to reach the target recall; what it has met is ranked by exact
cosines.  Calibration compares a bounded set of queries with all entries, so
that its number of entries holds for the table as it is, whatever its size.

Equal vectors are one entry with their smallest ids: no vector, however common,
is a cell of its own weight, and its queries are searched once.  Cells are laid
out in blocks of bounded size, large cells over several, and a block is handed
out once for every so many queries that ask for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import about, materialize, small_batches, table

#: About how many vectors the codebooks are fitted on, those whose hash is low, and the most numbers that they hold together; every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000
#: Share of the calibration queries' true neighbours that a search must meet, and about how many such queries there are.
TARGET_RECALL = 0.94
CALIBRATION_QUERIES = 400
#: Centroids for each half at most: bounds the table of cells at its square.
MOST_CENTROIDS = 1_024
#: Entries of a block, and queries that meet one block in one task.
BLOCK_ROWS, QUERY_ROWS = 2_048, 2_048


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each row; the same for equal rows, wherever they stand."""
    q, r = query / np.abs(query).max(), rows / np.abs(rows).max(axis=1, keepdims=True)
    return (r * q).sum(axis=1) / (np.sqrt((r * r).sum(axis=1)) * np.sqrt((q * q).sum()))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1), 0)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[draw.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _distances(x, centroids).argmin(1)
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


class MultiIndex:
    """Codebooks of both halves, and how many entries a search must meet."""

    def __init__(self, sample: np.ndarray, total: int, seed: int = 3) -> None:
        x = _unit(sample)
        self.half = max(1, x.shape[1] // 2)
        k = int(min(MOST_CENTROIDS, max(2, np.sqrt(total)), max(1, len(x) // 8) + 1))
        self.first, self.second = _kmeans(x[:, : self.half], k, seed), _kmeans(x[:, self.half :], k, seed + 1)
        self.enough = total

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = _unit(x)
        return _distances(x[:, : self.half], self.first).argmin(1) * len(self.second) + _distances(x[:, self.half :], self.second).argmin(1)

    def calibrate(self, queries: np.ndarray, near: list[list[int]], counts: np.ndarray) -> None:
        """``near``: the cells of each query's true neighbours.  Sets how many entries must be met so that TARGET_RECALL of them are."""
        needed = []
        for q, cells in zip(_unit(queries), near, strict=True):
            far = (_distances(q[None, : self.half], self.first)[0][:, None] + _distances(q[None, self.half :], self.second)[0]).ravel()
            order = far.argsort(kind="stable")
            met = np.empty(len(order), np.int64)
            met[order] = counts[order].cumsum()
            needed += met[cells].tolist()
        if needed:
            self.enough = int(np.quantile(needed, TARGET_RECALL, method="higher"))

    def visit(self, query: np.ndarray, counts: np.ndarray) -> list[int]:
        """Cells with entries, by summed distance, until they hold enough entries."""
        q = _unit(query[None, :])
        a, b = _distances(q[:, : self.half], self.first)[0], _distances(q[:, self.half :], self.second)[0]
        i_of, j_of = a.argsort(kind="stable"), b.argsort(kind="stable")
        a, b, width = a[i_of], b[j_of], len(b)
        met, out, heap = 0, [], [(a[0] + b[0], 0, 0)]
        while heap and met < self.enough:
            _, i, j = heapq.heappop(heap)
            cell = int(i_of[i]) * width + int(j_of[j])
            if counts[cell]:
                out.append(cell)
                met += int(counts[cell])
            if j + 1 < width:
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def _layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: whole cells share a block up to its size, larger ones are split."""
    base, splits, block, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK_ROWS:
            block, held = block + 1, 0
        base[cell], splits[cell] = block, max(1, -(-n // BLOCK_ROWS))
        held += n
        if splits[cell] > 1:
            block, held = block + int(splits[cell]), 0
    return base, splits


def _best(k: int, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def _rank(k: int):
    """For each query of a block the ``k`` best rows among the entries of the cells that it visits there."""
    schema = pa.schema([("cid", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        if not entries.num_rows or not queries.num_rows:
            return schema.empty_table()
        entries = entries.sort_by("cid")
        rows, ids = entries["rows"].to_pylist(), entries["ids"].to_pylist()
        least, cell, x = np.array([i[0] for i in ids]), entries["cell"].to_numpy(), _matrix(entries["v"])
        unit, q, q_cid, visited, out = _unit(x), _matrix(queries["q"]), queries["cid"].to_numpy(), queries["cells"], []
        for at in range(0, len(q), 256):
            near = _unit(q[at : at + 256]) @ unit.T
            for n in range(at, min(at + 256, len(q))):
                own = near[n - at]
                own[~np.isin(cell, np.asarray(visited[n].values))] = -np.inf
                limit = np.partition(own, -k)[-k] if len(own) > k else -np.inf
                some = np.flatnonzero((own >= limit - 1e-9) & (own > -np.inf))
                score = cosines(q[n], x[some])
                best = _best(k, least[some], score)
                members = [(int(q_cid[n]), r, i, float(score[b])) for b in best for r, i in zip(rows[some[b]], ids[some[b]], strict=True)]
                out += sorted(members, key=lambda m: (-m[3], m[2], m[1]))[:k]
        return pa.table([pa.array([o[c] for o in out], schema.field(c).type) for c in range(4)], schema=schema)

    return run


def _true_cells(entries: DataFrame, queries: pa.Table, k: int) -> list[list[int]]:
    """Cells of each query's ``k`` true neighbours: the queries, of a bounded number, against all entries; a task keeps ``k`` for each."""
    q_cid, q = queries["cid"].to_numpy(), _unit(_matrix(queries["v"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cells = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = q @ _unit(_matrix(batch.column("v"))).T
                near[q_cid[:, None] == batch.column("cid").to_numpy()] = -np.inf
                both = np.concatenate([score, near], axis=1)
                of = np.concatenate([cells, np.broadcast_to(batch.column("cell").to_numpy(), near.shape)], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                score, cells = np.take_along_axis(both, top, 1), np.take_along_axis(of, top, 1)
        n, j = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(score[n, j]), pa.array(cells[n, j])], ["n", "score", "cell"])

    found = entries.select("cid", "v", "cell").mapInArrow(run, "n int, score double, cell long")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "cell"))
    near: list[list[int]] = [[] for _ in range(len(q))]
    for r in found.withColumn("r", rank).where(F.col("r") <= k).collect():
        near[r["n"]].append(r["cell"])
    return near


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """``(cid, v, rows, ids, is_query)``: distinct vectors with their first ``keep`` rows by id; cid is the first one's row."""
    first = F.row_number().over(Window.partitionBy("v", "is_query").orderBy("vec_id", "row"))  # Spark drops all later rows before the shuffle
    some = rows.withColumn("n", first).where(F.col("n") <= keep)
    found = some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "row"))), 1, keep).alias("m"), F.max("is_query").alias("is_query"))
    return found.select(F.col("m")[0]["row"].alias("cid"), "v", F.col("m.row").alias("rows"), F.col("m.vec_id").alias("ids"), "is_query")


def _search(rows: DataFrame, size: int, k: int) -> DataFrame:
    """``(cid, row, vec_id, score)``: for each distinct query vector its ``k + 1`` best rows, itself among them; all of ``rows`` have ``size`` components."""
    spark, keep = rows.sparkSession, k + 1
    classes = materialize(_classes(rows, keep), "distinct-vectors")
    total = classes.count()
    sample = about(classes.select("cid", "v"), "cid", min(SAMPLE, max(1, SAMPLE_NUMBERS // size)), total).toArrow().sort_by("cid")
    index = MultiIndex(_matrix(sample["v"]), total) if sample.num_rows else MultiIndex(np.ones((1, size)), total)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            cell = pa.array(index.cells(x) if len(x) else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], [*batch.schema.names, "cell"])

    entries = materialize(classes.mapInArrow(assign, "cid long, v array<double>, rows array<long>, ids array<long>, is_query boolean, cell long"), "index-entries")
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row for each cell at most
        counts[r["cell"]] = r["count"]
    asked = entries.where("is_query")
    some = about(asked.select("cid", "v"), "cid", CALIBRATION_QUERIES, asked.count()).toArrow().sort_by("cid")
    if some.num_rows:
        index.calibrate(_matrix(some["v"]), _true_cells(entries, some, k), counts)
    base, splits = _layout(counts)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, block, cells = [], [], []
            for n, q in enumerate(_matrix(batch.column("v"))):
                at: dict[int, list[int]] = {}
                for c in index.visit(q, counts):
                    for s in range(int(splits[c])):
                        at.setdefault(int(base[c]) + s, []).append(c)
                for b, cs in at.items():
                    of.append(n), block.append(b), cells.append(cs)
            took = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(took), batch.column("v").take(took), pa.array(block, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["cid", "q", "block", "cells"])

    queries = materialize(asked.select("cid", "v").mapInArrow(visit, "cid long, q array<double>, block long, cells array<int>"), "visits")
    widths = materialize(queries.groupBy("block").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("width")), "block-widths")
    queries = queries.join(widths, "block").select("cid", "q", "block", "cells", F.pmod(F.xxhash64("cid"), F.col("width")).alias("part"))
    places = spark.createDataFrame(pa.table({"cell": np.arange(len(counts)), "base": base, "splits": splits}))
    at = (F.col("base") + F.pmod(F.xxhash64("cid"), F.col("splits"))).alias("block")
    dealt = entries.join(F.broadcast(places), "cell").select("cid", "v", "rows", "ids", "cell", at).join(widths, "block")
    dealt = dealt.withColumn("part", F.explode(F.expr("sequence(0L, width - 1)"))).drop("width")
    found = dealt.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(_rank(keep), "cid long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id", "row"))
    found = found.withColumn("n", rank).where(F.col("n") <= keep).drop("n")
    queried = rows.where("is_query").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v")
    return queried.join(materialize(asked.select("cid", "v"), "query-vectors"), "v").drop("v").join(materialize(found, "found"), "cid")


def nearest(vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest cosine found for each row that meets ``is_query``.

    Equal scores rank by the smaller id.  Null, empty and zero vectors, vectors
    with null or non-finite components and rows without id take no part.
    Vectors of each length are a collection of their own, as no cosine relates
    them to others; there is one search for each length.  Rows that repeat an
    id are rows of their own: each is searched for, and found for the others.
    An empty table gives no rows; fewer candidates than ``k`` are all found.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    given = vectors.where(sound).where(finite).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("is_query"))
    rows = materialize(given.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = [r["d"] for r in rows.where("is_query").select(F.size("v").alias("d")).distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, [_search(rows.where(F.size("v") == d), d, k) for d in sorted(sizes)])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.where("row <> query").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
