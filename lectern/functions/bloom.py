"""A Bloom filter as a column expression: keys that surely aren't in a set go before a shuffle.

The filter is one binary literal, six bits a byte so that every byte is an ASCII letter that the JVM reads in constant time. Its size
follows the number of keys up to MOST_BYTES; beyond that it lets more through, but never loses a key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, LEAST_BYTES, MOST_BYTES, BITS, FIRST = 12, 1 << 10, 1 << 20, 6, 48


class Bloom:
    def __init__(self, raw: bytes):
        self.raw = raw

    @classmethod
    def of(cls, keys: DataFrame) -> Bloom:
        """Of all rows of a frame, by all its columns; at most MOST_BYTES rows come to the driver."""
        n = keys.count()
        size = min(MOST_BYTES, max(LEAST_BYTES, n * BITS_A_KEY // BITS))
        places = keys.select(F.explode(F.array(*cls._places([F.col(c) for c in keys.columns], size))).alias("p"))
        found = places.groupBy(F.floor(F.col("p") / BITS).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % BITS).cast("int"))).alias("bits")).toArrow()
        raw = np.full(size, FIRST, np.uint8)
        raw[found["at"].to_numpy()] += found["bits"].to_numpy().astype(np.uint8)
        return cls(raw.tobytes())

    @staticmethod
    def _places(columns: list[Column], size: int) -> list[Column]:
        h = F.xxhash64(*columns)
        return [F.pmod(x, F.lit(size * BITS)) for x in (h, F.xxhash64(h))]

    def may_hold(self, *columns: str | Column) -> Column:
        """False only for keys that aren't in the set; null for none."""
        own = [F.col(c) if isinstance(c, str) else c for c in columns]
        hit = None
        for p in self._places(own, len(self.raw)):
            letter = F.substring(F.lit(self.raw), (F.floor(p / BITS) + 1).cast("int"), F.lit(1)).cast("string")
            bit = F.getbit(F.ascii(letter) - FIRST, (p % BITS).cast("int")) == 1
            hit = bit if hit is None else hit & bit
        return hit
