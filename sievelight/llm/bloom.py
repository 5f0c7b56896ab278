"""A Bloom filter sized by the number of its keys, built by tasks and OR-ed together as a stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.hashing import U, mix
from sievelight.llm.scratch import unused

#: Bits a key, and the least and most bits of a filter: 32 MB at most, whatever the
#: input.  With more keys than that serves, more rows go the exact way.
BITS_A_KEY = 12
LEAST, MOST = 1 << 20, 1 << 28
BLOCKS = 64


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    h = keys.astype(np.uint64)
    return [(mix(h + U(k)) & U(bits - 1)).astype(np.int64) for k in (1, 2, 3)]


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for p in _places(keys, 8 * len(bits)):
        out &= (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def build(keys: DataFrame) -> np.ndarray:
    """Packed bits of the filter of a stored table of one bigint column, whose rows are counted first."""
    size = LEAST
    wanted = min(MOST, BITS_A_KEY * keys.count())
    while size < wanted:
        size *= 2
    span = size // BLOCKS // 8

    def part(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in stream:
            if batch.num_rows:
                bits = np.zeros(size // 8, dtype=np.uint8) if bits is None else bits
                for p in _places(batch.column(0).to_numpy(), size):
                    np.bitwise_or.at(bits, p >> 3, (128 >> (p & 7)).astype(np.uint8))
        if bits is not None:
            packed = [zlib.compress(bits[i * span : (i + 1) * span].tobytes(), 1) for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

    def merge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
                total[block] = total[block] | got if block in total else got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "bits"])

    out = np.zeros((BLOCKS, span), dtype=np.uint8)
    schema = "block int, bits binary"
    for r in keys.mapInArrow(part, schema).repartition(BLOCKS, "block").mapInArrow(merge, schema).collect():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def split(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``key`` (bigint, not null) is certainly not among ``keys``, and the others, which are few.

    Rows of the first part pass as they are, without a shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(build(keys))
    (name,) = unused(rows.columns, "key")
    keyed = rows.withColumn(name, key)

    def part(hit: bool) -> DataFrame:
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                found = contains(shared.value, batch.column(batch.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(found == hit))

        return keyed.mapInArrow(run, rows.schema)

    return part(False), part(True)


def row_key(*columns: str) -> Column:
    """A 64-bit key of the values of some columns, null or not."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])
