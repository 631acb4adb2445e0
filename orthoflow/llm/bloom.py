"""A Bloom filter of a bounded size over 64-bit keys, built by the tasks block by block.

It only spares work: what it lets through by mistake is told apart exactly afterwards, so its size
(and with it the driver's and the broadcast's share) is fixed by a parameter, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.common import mix

BLOCK_BITS = 19  # 64 KB
_SALTS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


class Bloom:
    """Blocks of 2^19 bits; the key's top bits choose the block, three hashes the bits in it."""

    def __init__(self, blocks_log2: int, bits: np.ndarray):
        self.blocks_log2, self.bits = blocks_log2, bits  # uint8, one row per block

    def has(self, keys: np.ndarray) -> np.ndarray:
        block = block_of(keys, self.blocks_log2)
        out = np.ones(len(keys), bool)
        for salt in _SALTS:
            bit = mix(keys ^ salt) >> np.uint64(64 - BLOCK_BITS)
            out &= (self.bits[block, (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def block_of(keys: np.ndarray, blocks_log2: int) -> np.ndarray:
    return (keys >> np.uint64(64 - blocks_log2)).astype(np.int64) if blocks_log2 else np.zeros(len(keys), np.int64)


def _builder(blocks_log2: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block = block_of(keys, blocks_log2)
            for b in np.unique(block).tolist():
                own = keys[block == b]
                bits = blocks.setdefault(b, np.zeros(1 << (BLOCK_BITS - 3), np.uint8))
                for salt in _SALTS:
                    bit = mix(own ^ salt) >> np.uint64(64 - BLOCK_BITS)
                    np.bitwise_or.at(bits, (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "bits"])

    return build


def bloom(keys: DataFrame, column: str, max_bytes: int = 32 << 20, bits_per_key: int = 12) -> Bloom:
    """The filter of a staged table's column of well-mixed hashes; ``max_bytes`` bounds it whatever the table."""
    wanted = keys.count() * bits_per_key
    most = max(0, (max_bytes * 8 >> BLOCK_BITS).bit_length() - 1)
    log2 = min(most, max(0, (wanted >> BLOCK_BITS).bit_length()))
    # every block is built whole by one task: its keys are sent to it, not its bits to a merger
    block = F.shiftrightunsigned(F.col(column), 64 - log2) if log2 else F.lit(0)
    made = keys.select(F.col(column).alias("key"), block.alias("block")).repartition("block").mapInArrow(_builder(log2), "block int, bits binary")
    bits = np.zeros((1 << log2, 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in made.coalesce(8).toLocalIterator():  # a job for each partition
        bits[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
    return Bloom(log2, bits)
