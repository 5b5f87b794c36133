"""A set of 64-bit keys as bits of a bounded size, built in the tasks: what is in the set is always found, other keys rarely.

It only spares later work; an exact step must follow. The bits are cut into segments by the upper part of the key, and each
segment is made in one task, so the driver receives the bits once and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = 256
# 64 MB. Beyond this many bits the set lets more keys pass; nothing is lost.
MAX_BITS = 1 << 29
BITS_PER_KEY = 16


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places per key; ``bits`` is a power of two. The segment is the key's upper byte."""
    within = np.uint64(bits // SEGMENTS - 1)
    segment = (keys >> np.uint64(56)) * np.uint64(bits // SEGMENTS)
    with np.errstate(over="ignore"):
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return segment + (mixed & within), segment + ((keys >> np.uint64(20)) & within)


class Bits:
    """The finished set; sent to the tasks as one broadcast of its bits."""

    def __init__(self, spark, packed: np.ndarray):
        self.sent = spark.sparkContext.broadcast(packed)

    def has(self, keys: np.ndarray) -> np.ndarray:
        packed = self.sent.value
        found = np.ones(len(keys), bool)
        for at in _places(keys, 8 * len(packed)):
            found &= ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        return found


def build(keys: DataFrame, count: int, max_bits: int = MAX_BITS) -> Bits:
    """``keys`` has one bigint column ``key`` (the 64 bits) and about ``count`` rows."""
    bits = 1 << max(14, min(int(max_bits).bit_length() - 1, (BITS_PER_KEY * max(1, count)).bit_length()))
    size = bits // SEGMENTS // 8

    def task(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            for at in _places(keys, bits):
                segment = (at // np.uint64(8 * size)).astype(np.int64)
                for s in np.unique(segment):
                    local = (at[segment == s] - np.uint64(8 * size * s)).astype(np.int64)
                    part = made.setdefault(int(s), np.zeros(size, np.uint8))
                    np.bitwise_or.at(part, local >> 3, (1 << (local & 7)).astype(np.uint8))
        for s, part in sorted(made.items()):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["segment", "part"])

    placed = keys.repartition(F.shiftrightunsigned("key", 56)).mapInArrow(task, "segment int, part binary")
    packed = np.zeros(bits // 8, np.uint8)
    for row in placed.toLocalIterator():
        at = row["segment"] * size
        packed[at : at + size] |= np.frombuffer(bytes(row["part"]), np.uint8)
    return Bits(keys.sparkSession, packed)
