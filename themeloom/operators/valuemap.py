"""Bit maps of 64-bit hash values, of a fixed largest size: what tasks may hold of a table of any size, to rule out rows before they are shuffled to it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ValueMap:
    """Two bits for each value, by its highest and by its lowest bits."""

    bits: int
    packed: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, most_bits: int = 27) -> ValueMap:
        """The map of values that are at hand."""
        bits = min(most_bits, max(16, (64 * len(values)).bit_length()))
        packed = np.zeros(1 << (bits - 6), np.uint64)
        for at in (values >> np.uint64(64 - bits), values & np.uint64((1 << bits) - 1)):
            np.bitwise_or.at(packed, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return cls(bits, packed)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        """False where a value surely isn't in the map."""
        low = values & np.uint64((1 << self.bits) - 1)
        high = values >> np.uint64(64 - self.bits)
        test = lambda at: (self.packed[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        out = test(high).astype(bool)
        out[out] = test(low[out]).astype(bool)
        return out


def value_map(table: DataFrame, column: str, most_bits: int = 27) -> ValueMap:
    """The map of a bigint column: 64 bits a value, up to 2 ** `most_bits` bits in all; beyond, it rules out less, never too much. It is put together by the executors; the driver gets the map alone."""
    values = table.select(F.col(column).alias("value")).where("value is not null").distinct()
    bits = min(most_bits, max(16, (64 * values.count()).bit_length()))
    slots = F.array(F.shiftrightunsigned("value", 64 - bits), F.col("value").bitwiseAND(F.lit((1 << bits) - 1)))
    words = values.select(F.explode(slots).alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word"))
    packed = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toArrow()  # at most 2 ** (bits - 6) rows
    packed[rows.column("at").to_numpy()] = rows.column("word").to_numpy().astype(np.int64).view(np.uint64)
    return ValueMap(bits, packed)
