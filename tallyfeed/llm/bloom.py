"""A blocked Bloom filter over 64-bit hashes, sized from the number of keys up to a fixed largest size.

Each key has one 64-bit block and four bits in it, so a lookup reads one word. It
is built by a bitwise-or aggregate keyed by block: at most ``blocks`` rows reach
the driver, whatever the number of keys. A full filter passes more keys, never
fewer, so what it guards stays right at any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows


def block_of(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and bit mask of each key (hashes, unsigned)."""
    mask = np.zeros(len(x), np.uint64)
    for i in range(4):
        mask |= np.uint64(1) << ((x >> np.uint64(40 + 6 * i)) & np.uint64(63))
    return (x & np.uint64(blocks - 1)).astype(np.int64), mask


def blocks_for(keys: int, least: int = 1 << 12, most: int = 1 << 23) -> int:
    """A power of two of blocks with at most four keys each (one false hit in 300), within 32 kB and 64 MB."""
    return max(least, min(most, 1 << max(0, -(-keys // 4) - 1).bit_length()))


def build(keys: DataFrame, blocks: int = 1 << 18) -> np.ndarray:
    """The filter's blocks, of a DataFrame whose one column is a 64-bit hash (bigint)."""
    x = F.col(keys.columns[0])
    mask = F.lit(0).cast("bigint")
    for i in range(4):
        bit = F.shiftrightunsigned(x, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    found = keys.groupBy(x.bitwiseAND(F.lit(blocks - 1)).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    table = np.zeros(blocks, np.uint64)
    table[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def probe(df: DataFrame, table: np.ndarray, key: str, out: str) -> DataFrame:
    """df with the boolean ``out``: whether the filter may hold the row's hash (a null hash: no)."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(hashes):
        x = np.array([0 if h is None else h for h in hashes], np.int64).view(np.uint64)
        at, mask = block_of(x, len(shared.value))
        return ((((shared.value[at] & mask) == mask) & np.array([h is not None for h in hashes], bool)).tolist(),)

    return map_rows(df, run, f"`{out}` boolean", [key])
