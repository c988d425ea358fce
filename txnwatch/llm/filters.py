"""A membership filter that is built in Spark, sized from its keys, and sent to tasks."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key; with two bits set, about one other hash in seventy passes.
BITS_PER_KEY = 16
#: 2 MB, which lets next to nothing else through while keys are few, to 32 MB. At the upper bound, from 16 million keys on, more others pass (one in four at 100 million).
LEAST_LOG2, MOST_LOG2 = 24, 28


def log2_bits(keys: int) -> int:
    """The size for a number of keys, as a power of two."""
    return min(max((max(keys, 1) * BITS_PER_KEY - 1).bit_length(), LEAST_LOG2), MOST_LOG2)


class HashFilter:
    """Two bits for each hash. Without false negatives; a full filter only lets more through.

    It travels compressed: with few keys it is almost all zeros, and executors keep what travels for a while.
    """

    def __init__(self, flags: bytes):
        self.flags = flags
        self.log2 = (8 * len(flags)).bit_length() - 1

    def __getstate__(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.flags)

    def __setstate__(self, state: bytes) -> None:
        self.__init__(zstandard.ZstdDecompressor().decompress(state))

    @staticmethod
    def of(hashes: DataFrame, column: str, keys: int | None = None) -> HashFilter:
        """The filter of the distinct 64-bit hashes in ``column``; ``keys`` is their number where it is known.

        The bitmap is merged by words of 64 bits in the cluster, so at most a row for each
        word of the filter arrives (4 million at its upper bound). Give a frame that is cheap to read twice.
        """
        log2 = log2_bits(hashes.count() if keys is None else keys)
        slots = F.array(F.col(column).bitwiseAND((1 << log2) - 1), F.shiftrightunsigned(column, 64 - log2))
        words = (
            hashes.select(F.explode(slots).alias("slot"))
            .select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
            .groupBy("word")
            .agg(F.bit_or("bits").alias("bits"))
            .toArrow()
        )
        flags = np.zeros(1 << (log2 - 6), np.int64)
        flags[words["word"].to_numpy()] = words["bits"].to_numpy()
        return HashFilter(flags.tobytes())

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bits, mask, top = np.frombuffer(self.flags, np.uint8), np.uint64((1 << self.log2) - 1), np.uint64(64 - self.log2)

        def set_at(slot: np.ndarray) -> np.ndarray:
            return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        hashes = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64, copy=False)
        found = set_at(hashes & mask)
        at = np.flatnonzero(found)
        found[at] = set_at(hashes[at] >> top)
        return found
