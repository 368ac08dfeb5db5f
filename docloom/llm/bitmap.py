"""A bitmap of hashed values, built by the executors and sent back to them: a first sieve before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Bitmap:
    """No false negatives, and of a size set by bounds, not by the data: what passes still has to be joined.

    The values are longs that are hashes already, or any column hashed by ``place``.
    """

    def __init__(self, places: DataFrame, bits: int) -> None:
        """``places(place long)`` lie from 0 to ``bits - 1``; one row for each 4 KB that has any comes to the driver."""
        slot = F.col("place") + 1  # the bitmap functions count from 1
        parts = places.select(slot.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
        self.bits, bytes_ = bits, np.zeros(bits // 8, np.uint8)
        for p in parts:
            at = (p["k"] - 1) * 4096
            bytes_[at : at + 4096] = np.frombuffer(p["m"], np.uint8)
        self._shared = places.sparkSession.sparkContext.broadcast(bytes_)

    @staticmethod
    def bits_for(count: int, least: int = 15, most: int = 27) -> int:
        """A power of two with some sixteen bits for each value, within the bounds: 16 MB at most."""
        return 1 << min(most, max(least, (16 * max(1, count)).bit_length()))

    @staticmethod
    def place(column: str, bits: int) -> Column:
        """Place of a value that is no hash yet."""
        return F.pmod(F.xxhash64(column), F.lit(bits))

    @classmethod
    def of_hashes(cls, hashes: DataFrame, column: str, most: int = 27) -> Bitmap:
        """Of values that are hashes already: each sets the bits that its low and its high half name."""
        bits = cls.bits_for(2 * hashes.count(), most=most)
        mask = F.lit(bits - 1).cast("long")
        both = F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))
        return cls(hashes.select(F.explode(both).alias("place")), bits)

    def may_hold(self, places: np.ndarray) -> np.ndarray:
        return (self._shared.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1

    def may_hold_hash(self, hashes: np.ndarray) -> np.ndarray:
        given, mask = hashes.view(np.uint64), np.uint64(self.bits - 1)
        out = self.may_hold((given & mask).view(np.int64))
        at = np.flatnonzero(out)
        out[at] = self.may_hold(((given[at] >> np.uint64(32)) & mask).view(np.int64))
        return out
