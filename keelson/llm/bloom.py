"""A Bloom filter of 64-bit hashes, made by Spark and asked by Python workers.

It has BITS_A_HASH bits for each hash, within fixed bounds, so what is broadcast is
at most MOST_BITS.  Beyond that it lets more through: whoever asks must be exact
without it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_A_HASH = 16
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28


def bloom_filter(hashes: DataFrame):
    """A broadcast filter over column h; the driver gets at most two longs for 64 of its bits."""
    spark = hashes.sparkSession
    n_bits = LEAST_BITS
    wished = min(MOST_BITS, BITS_A_HASH * hashes.count())
    while n_bits < wished:
        n_bits *= 2
    low = F.col("h").bitwiseAND(F.lit(n_bits - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(n_bits - 1))
    spots = hashes.select(F.explode(F.array(low, high)).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    found = words.toArrow()
    filled = np.zeros(n_bits // 64, np.int64)
    filled[found["word"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(filled.tobytes())


def bloom_holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each signed hash 1 if it may be in the filter, 0 if it isn't; ``bits``: the broadcast's bytes."""
    u, mask = hashes.view(np.uint64), np.uint64(8 * len(bits) - 1)
    x, y = (u & mask).astype(np.int64), ((u >> np.uint64(32)) & mask).astype(np.int64)
    return (bits[x >> 3] >> (x & 7)) & (bits[y >> 3] >> (y & 7)) & 1
