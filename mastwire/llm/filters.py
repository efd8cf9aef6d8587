"""A filter of fixed size for the rows that a join can keep, so that the others are never shuffled."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of the filter. Its size never grows: beyond about as many values it only lets more rows through.
BITS = 26
RANGES = 64


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)


def marked(hashes: DataFrame) -> np.ndarray:
    """One bit for each slot that a hash of the one long column has, put together range by range."""
    size = (1 << BITS) // 8
    width = size // RANGES

    def mark(batches):
        bits = np.zeros(size, dtype=np.uint8)
        for batch in filter(len, batches):
            byte, bit = _places(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, byte, np.uint8(1) << bit)
        parts = [zlib.compress(bits[r * width : (r + 1) * width].tobytes(), 1) for r in range(RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], names=["r", "part"])

    def merge(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(zlib.decompress(part), np.uint8)
                out[r] = out[r] | raw if r in out else raw
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(
            [zlib.compress(x.tobytes(), 1) for x in out.values()], pa.binary())], names=["r", "part"])

    bits = np.zeros(size, dtype=np.uint8)
    for row in hashes.mapInArrow(mark, "r int, part binary").repartition("r").mapInArrow(merge, "r int, part binary").collect():
        bits[row.r * width : (row.r + 1) * width] = np.frombuffer(zlib.decompress(row.part), np.uint8)
    return bits


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    byte, bit = _places(hashes)
    return bits[byte] >> bit & 1 > 0


def passing(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows whose hash the filter holds (and some others)."""
    at = df.columns.index(column)

    def run(batches):
        for batch in filter(len, batches):
            yield batch.filter(pa.array(holds(bits, batch.column(at).to_numpy())))

    return df.mapInArrow(run, df.schema)
