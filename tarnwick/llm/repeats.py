"""A count-min sketch that saturates at two, merged from partition sketches.

Each row of the sketch is a bitmap of the cells that were hit at least twice. A
partition sends, per block of cells, one compressed bitmap of cells hit once or
more and one of cells hit twice or more; blocks are merged by a tree of bounded
groups. The merged bitmaps have a fixed size, ``rows * cells / 8`` bytes, whatever
the input. ``Repeats.maybe`` never says no of a value that was added twice.

Defined results: without rows, or without values, all bitmaps are empty and nothing
may repeat; values repeat across rows, batches and partitions alike; what is null is
for ``values`` to leave out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import drop_stored, stored

from .common import trimmed

BLOCK_BITS = 20
#: Partition sketches that one merging group reads.
FAN_IN = 32
#: Cells of one row: at least, at most (2**30 cells are 128 MB of bitmap).
LEAST_BITS, MOST_BITS = 21, 30

#: Frequent values that are listed at most, and values that a partition counts at a time.
HEAVY_MOST, HEAVY_HELD = 200_000, 2_000_000

_SCHEMA = "block long, task long, once binary, twice binary"


def cell_bits(expected: float, per_value: float = 4.0) -> int:
    """log2 of the cells of a row for so many values, within the fixed bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1.0, expected * per_value))))))


def cells_of(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each 64-bit value in a row of the sketch; rows use different bits of it."""
    turned = values if row == 0 else (values >> np.uint64(32)) | (values << np.uint64(32))
    return (turned >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    bitmap = np.zeros(1 << BLOCK_BITS, dtype=bool)
    bitmap[cells] = True
    return zlib.compress(np.packbits(bitmap).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=np.uint8)


class _Partition:
    """The sketch of one partition: sorted cells, merged now and then to stay small."""

    def __init__(self, rows: int, bits: int):
        self.bits, self.rows = bits, rows
        self.new: list[list[np.ndarray]] = [[] for _ in range(rows)]
        self.size = 0
        self.once = [np.zeros(0, dtype=np.uint32) for _ in range(rows)]
        self.twice = [np.zeros(0, dtype=np.uint32) for _ in range(rows)]

    def add(self, values: np.ndarray) -> None:
        for r in range(self.rows):
            self.new[r].append(cells_of(values, r, self.bits))
        self.size += len(values)
        if self.size > 2_000_000:
            self.merge()

    def merge(self) -> None:
        for r in range(self.rows):
            x = np.sort(np.concatenate([self.once[r], *self.new[r]]))
            again = x[1:][x[1:] == x[:-1]]
            self.once[r], self.twice[r], self.new[r] = _distinct(x), _distinct(np.sort(np.concatenate([self.twice[r], again]))), []
        self.size = 0

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        self.merge()
        for r in range(self.rows):
            for b in range(1 << (self.bits - BLOCK_BITS)):
                lo, hi = np.uint32(b << BLOCK_BITS), np.uint32(((b + 1) << BLOCK_BITS) - 1)
                one = self.once[r][np.searchsorted(self.once[r], lo) : np.searchsorted(self.once[r], hi, side="right")]
                two = self.twice[r][np.searchsorted(self.twice[r], lo) : np.searchsorted(self.twice[r], hi, side="right")]
                if len(one):
                    yield (r << 32) + b, _pack(one - lo), _pack(two - lo)


def _distinct(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _merge_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros((1 << BLOCK_BITS) // 8, dtype=np.uint8)
    twice = once.copy()
    for a, b in zip(pdf["once"], pdf["twice"]):
        a = _unpack(a)
        twice |= _unpack(b) | (once & a)
        once |= a
    return pd.DataFrame({"block": [key[0]], "task": [key[1]], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})


class Repeats:
    """The merged sketch: which values may have been added twice or more."""

    def __init__(self, rows: int, bits: int, bitmaps: list[np.ndarray]):
        self.rows, self.bits, self.bitmaps = rows, bits, bitmaps

    def maybe(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for r in range(self.rows):
            c = cells_of(values, r, self.bits)
            out &= (self.bitmaps[r][c >> np.uint32(3)] >> (np.uint8(7) - (c & np.uint32(7)).astype(np.uint8))) & np.uint8(1) != 0
        return out


def build(
    docs: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], rows: int, bits: int, heavy: int = 0, least: int = 2
) -> tuple[Repeats, np.ndarray, np.ndarray]:
    """Sketch what ``values`` yields for the record batches of ``docs``.

    ``least`` 1 makes the bitmaps those of cells hit at all: which values may be there.

    With ``heavy``, also the values that some partition holds at least so often: the
    ``HEAVY_MOST`` most frequent ones, sorted, and the counts that such partitions
    found. These serve as weights; a value that is not listed has a count below
    ``heavy`` in every partition.
    """

    def sketch(batches):
        from pyspark import TaskContext

        part, held, size, any_rows = _Partition(rows, bits), [], 0, False
        task = TaskContext.get().partitionId()
        for batch in batches:
            for v in values(batch):
                any_rows = True
                part.add(v)
                if heavy:
                    held.append(v)
                    size += len(v)
                    if size > HEAVY_HELD:
                        yield from _heavy_rows(held, heavy, task)
                        held, size = [], 0
        if held:
            yield from _heavy_rows(held, heavy, task)
        if any_rows:
            for block, one, two in part.blocks():
                yield _row(block, task, one, two)

    parts = docs.mapInArrow(trimmed(sketch), _SCHEMA)
    if heavy:
        parts = stored(parts, "sketch")
    merged = parts.filter("block >= 0")
    # Rounds for so many partitions; whatever they have left of a block, the last round merges.
    last = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).head()[0] or 0
    while True:
        last //= FAN_IN
        task = F.floor(F.col("task") / FAN_IN) if last else F.lit(0).cast("long")
        merged = merged.withColumn("task", task).groupBy("block", "task").applyInPandas(_merge_group, _SCHEMA)
        if not last:
            break
    bitmaps = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(rows)]
    size = (1 << BLOCK_BITS) // 8
    for x in merged.select("block", "once" if least == 1 else "twice").collect():  # of fixed size, whatever the input: a row per block
        part = bitmaps[x[0] >> 32][(x[0] & 0xFFFFFFFF) * size :][:size]
        part |= _unpack(x[1])
    top: tuple = ((), ())
    if heavy:
        counted = (
            parts.filter("block < 0").select("once", "twice").mapInArrow(_heavy_values, "value long, n long")
            .groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(HEAVY_MOST).collect()
        )
        top = tuple(zip(*counted)) or top
        drop_stored(parts)
    found = np.array(top[0], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return Repeats(rows, bits, bitmaps), found[order], np.array(top[1], dtype=np.int64)[order]


def _row(block: int, task: int, once: bytes, twice: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([task], pa.int64()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())],
        names=["block", "task", "once", "twice"],
    )


def _heavy_rows(held: list[np.ndarray], least: int, task: int) -> Iterator[pa.RecordBatch]:
    x = np.sort(np.concatenate(held))
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(cut, len(x)))
    often = n >= least
    if often.any():
        yield _row(-1, task, x[cut[often]].tobytes(), n[often].astype(np.int64).tobytes())


def _heavy_values(batches):
    for batch in batches:
        for once, twice in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(once, dtype=np.int64)), pa.array(np.frombuffer(twice, dtype=np.int64))], names=["value", "n"])
