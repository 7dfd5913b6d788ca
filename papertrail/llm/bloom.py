"""A bit table of fixed size over 64-bit hashes: a broadcast whose size does not depend on the data.

It only lets rows through that may match; an exact join follows.  With more keys more rows pass, none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 24  # 2^24 bits, 2 MB


def _places(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, s).bitwiseAND((1 << bits) - 1) for s in (0, bits)]


def build(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Bytes of the bit table of a long column; words of 64 bits are put together before they reach the driver."""
    rows = keys.select(F.explode(F.array(*_places(F.col(column), bits))).alias("p")) \
        .groupBy(F.shiftright("p", 6).alias("word")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v")).toArrow()  # at most 2^(bits - 6) rows of 16 bytes
    table = np.zeros(1 << (bits - 6), "<i8")
    table[rows["word"].to_numpy()] = rows["v"].to_numpy()
    return table.view(np.uint8)


def test(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be among the keys."""
    bits = int(len(table) * 8).bit_length() - 1
    found = np.ones(len(h), bool)
    for shift in (0, bits):
        p = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        found &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found
