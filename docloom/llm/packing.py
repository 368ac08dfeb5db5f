"""Best-fit packing of tokenised documents by a distributed grouping genetic algorithm.

Texts are tokenised once, in place; what is shuffled are the pieces' lengths.
Pieces are dealt to shards of a fixed size by hash.  Each shard is evolved by
some islands, whose best individuals migrate around a ring between epochs; the
best of all islands wins.  Bins that stay loosely filled are packed once more,
across shards, so that the loss doesn't grow with their number.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, small_batches, table
from docloom.llm.grouping import Island, decode, encode

#: Pieces of a shard on average: bounds what one task holds.
SHARD_PIECES = 16_384
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 2, 6, 3, 6
#: White space runs from which a text goes to the library: the faster encoder's pattern gives up on some longer ones.
LONG_SPACE = 50_000
#: Bins with more of their room left than this share are packed again across shards.
LOOSE = 0.02
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "shard long, island int, place int, fitness double, crossed long, bins binary"
_PLACED = "item long, shard long, bin int, offset long, room long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Ids of a text as ``tokenizers`` gives them for this byte-level BPE file.

    The file's own vocabulary is handed to a faster encoder of the same merges;
    a text that holds one of its special strings, or a very long run of white
    space, goes to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = [t["content"] for t in given.get("added_tokens", [])]
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    if given["model"]["type"] != "BPE" or (given.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or given.get("normalizer") or given["pre_tokenizer"].get("add_prefix_space"):
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; others follow from 256 on
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("of the file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    spaces = re.compile(r"\s{%d}" % LONG_SPACE)

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special) or (len(text) >= LONG_SPACE and spaces.search(text)):
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def _cut(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = _encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encode_text(text.as_py()), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % limit + 1
                for k, at in enumerate([0, *range(first, len(ids), limit)]):
                    size = first if k == 0 else limit
                    rows.append(row), piece.append(k), start.append(at), length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size].tobytes()))
            doc = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_pieces(documents: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``limit`` ids of each document's ids and the end id: ``(doc_id, piece, start, length, ids_crc32)``.

    Only longer documents are cut, so that all pieces but the first have
    exactly ``limit`` ids.  A null text counts as empty and has the end id alone.
    """
    small_batches(documents.sparkSession)
    given = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(_cut(tokenizer_path, limit, end_id), _PIECES)


def _ordered(pieces: pd.DataFrame) -> pd.DataFrame:
    return pieces.sort_values(["length", "item"], ascending=[False, True], kind="stable", ignore_index=True)


def _population(island: Island, shard: int, number: int) -> pd.DataFrame:
    n = len(island.sizes)
    return pd.DataFrame([(shard, number, k, s, island.crossed, encode(b, n)) for k, (s, b) in enumerate(island.members)], columns=["shard", "island", "place", "fitness", "crossed", "bins"])


def _evolve(limit: int, epoch: int):
    def seed(shard: int, island: int) -> int:
        return (shard * 1_000_003 + island * 101 + epoch) & 0x7FFFFFFF

    def first(key, pieces: pd.DataFrame) -> pd.DataFrame:
        island = Island(_ordered(pieces)["length"].to_numpy(), limit, seed(*map(int, key)), POPULATION)
        island.start()
        island.evolve(GENERATIONS)
        return _population(island, *map(int, key))

    def again(key, pieces: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        island = Island(_ordered(pieces)["length"].to_numpy(), limit, seed(*map(int, key)), POPULATION)
        island.crossed = int(members["crossed"].max())
        for data in members.sort_values(["fitness", "place"], ascending=[False, True])["bins"]:
            island.add(decode(data))
        island.evolve(GENERATIONS)
        return _population(island, *map(int, key))

    return first if epoch == 0 else again


def _place(limit: int):
    def run(pieces: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        pieces, bins = _ordered(pieces), decode(best["bins"].iloc[0])
        size, out = pieces["length"].to_numpy(), []
        for k, b in enumerate(bins):
            at, room = 0, limit - int(size[b].sum())
            for i in b:
                out.append((k, at, room, i))
                at += int(size[i])
        found = pd.DataFrame(out, columns=["bin", "offset", "room", "i"])
        return pd.DataFrame({"item": pieces["item"].to_numpy()[found["i"]], "shard": pieces["shard"].to_numpy()[found["i"]], "bin": found["bin"].astype("int32"), "offset": found["offset"], "room": found["room"]})

    return run


def _shards(count: int) -> int:
    return max(1, round(count / SHARD_PIECES))


def _evolved(items: DataFrame, shards: int, limit: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The items with their shards, and the last populations of all islands: epochs apart, each island's elite moves on to the next of its ring."""
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"))
    on_islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    state = on_islands.groupBy("shard", "island").applyInPandas(_evolve(limit, 0), _STATE)
    for epoch in range(1, EPOCHS):
        state = materialize(state, "islands")
        to = F.when(F.col("place") == 0, F.array(F.col("island"), (F.col("island") + 1) % ISLANDS)).otherwise(F.array("island"))
        moved = state.withColumn("island", F.explode(F.array_distinct(to)))
        state = on_islands.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInPandas(_evolve(limit, epoch), _STATE)
    return dealt, state


def _pack(items: DataFrame, count: int, limit: int, level: int) -> DataFrame:
    """``(item, shard, bin, offset, room)`` of each item: islands, migration of elites, the best individual of each shard."""
    dealt, state = _evolved(items, _shards(count), limit, level)
    best = state.where("place = 0").groupBy("shard").agg(F.max_by("bins", F.struct("fitness", -F.col("island"))).alias("bins"))
    return materialize(dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(_place(limit), _PLACED), "placed")


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """All rows and columns of ``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``limit`` ids, gapless from 0.

    Pieces of the full length have a sequence of their own.  ``pieces`` needs a
    column ``length`` from 1 to ``limit``; ties in length go by row, repeated
    rows are pieces of their own, and an empty table gives no rows.
    """
    rows = materialize(pieces.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    items = rows.where(F.col("length") < limit).select(F.col("__item").alias("item"), "length")
    count = items.count()
    whole = rows.where(F.col("length") >= limit).withColumns({"sequence_id": -F.col("__item") - 1, "offset": F.lit(0).cast("long")})
    if not count:
        return whole.drop("__item")

    def numbered(df: DataFrame, level: int) -> DataFrame:
        return df.select("item", (F.lit(level << 61) + F.shiftleft("shard", 28) + F.col("bin")).alias("sequence_id"), "offset")

    placed = _pack(items, count, limit, 0)
    if _shards(count) > 1:
        tight = F.col("room") <= int(LOOSE * limit)
        loose = placed.where(~tight).join(items, "item").select("item", "length")
        left = loose.count()
        found = numbered(placed.where(tight), 0)
        placed_all = found.unionByName(numbered(_pack(materialize(loose, "loose"), left, limit, 1), 1)) if left else found
    else:
        placed_all = numbered(placed, 0)
    packed = rows.join(placed_all, rows["__item"] == placed_all["item"]).drop("item")
    return packed.unionByName(whole).drop("__item")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
