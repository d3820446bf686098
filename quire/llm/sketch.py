"""Count-min sketches of item hashes over a corpus, kept as far as counts of one and of two or more.

Every task sketches its own items and emits, block by block, the cells it saw once and those it saw again. Blocks are
merged in parallel, streaming over sorted rows, so no task holds more than one block of cells. The merged sketch
overestimates: an item seen twice or more has only cells seen twice or more, so it is never missed.

The sketch has rows * 2**bits cells whatever the corpus, so what reaches the driver and is broadcast is at most
rows * 2**bits / 8 bytes (32 MB by default). As the corpus outgrows it more items are taken for repeated ones and the
exact pass that follows has more to do; its result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import U64, Block, blocks, small_batches

BLOCK_BITS = 16
FLUSH_ITEMS = 1_000_000


def encoded(cells: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted distinct cells as (block, bytes): gaps in a byte each, 255 standing for a gap that goes on."""
    block, low = cells >> BLOCK_BITS, cells & ((1 << BLOCK_BITS) - 1)
    new = np.ones(len(cells), dtype=bool)
    new[1:] = block[1:] != block[:-1]
    gap = low.copy()
    gap[1:][~new[1:]] -= low[:-1][~new[1:]]
    more = gap // 255
    last = np.cumsum(more + 1) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, 255, dtype=np.uint8)
    out[last] = gap % 255
    begin = (last - more)[new]
    offsets = np.append(begin, len(out)).astype(np.int32)
    return block[new].astype(np.int32), pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def decoded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


class Repeats:
    """The merged sketch's cells of count two or more, as broadcast bits."""

    def __init__(self, bits: int, rows: int, shared) -> None:
        self.bits, self.rows, self.shared = bits, rows, shared

    def release(self) -> None:
        """Frees the bits on the driver and the executors, once nothing that uses them is still to be computed."""
        self.shared.destroy()

    def of(self, h: np.ndarray) -> np.ndarray:
        """Whether each item hash is estimated to occur twice or more."""
        packed = np.frombuffer(self.shared.value, dtype=np.uint8)
        found = np.ones(len(h), dtype=bool)
        for row in cells_of(h, self.bits, self.rows):
            found &= (packed[row >> 3] >> (row & 7).astype(np.uint8)) & 1 > 0
        return found


def cells_of(h: np.ndarray, bits: int, rows: int) -> list[np.ndarray]:
    """An item's cell in each row, from disjoint bits of its hash."""
    mask = U64((1 << bits) - 1)
    return [((h >> U64(j * 32)) & mask).astype(np.int64) + (j << bits) for j in range(rows)]


def repeats(docs: DataFrame, items: Callable[[Block], np.ndarray], lower: bool = False, bits: int = 27, rows: int = 2) -> Repeats:
    """The repeated items of docs' texts; items gives the hashes of a block's items, one for each occurrence."""

    small_batches(docs.sparkSession)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        for row in cells_of(h, bits, rows):
            cells = np.sort(row)
            first = np.ones(len(cells), dtype=bool)
            first[1:] = cells[1:] != cells[:-1]
            once = cells[first]
            again = np.unique(cells[~first])
            for level, found in ((1, once), (2, again)):
                if len(found):
                    block, data = encoded(found)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.full(len(block), level, np.int8)), data], names=["block", "level", "cells"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, block in blocks(batches, lower):
            held.append(items(block))
            n += len(held[-1])
            if n >= FLUSH_ITEMS:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, level, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at:
                    if at is not None and again.any():
                        yield done()
                    at = block
                    once[:] = again[:] = False
                cells = decoded(data)
                if level == 1:
                    again[cells[once[cells]]] = True
                    once[cells] = True
                else:
                    again[cells] = True
        if at is not None and again.any():
            yield done()

    seen = docs.select("text").mapInArrow(sketch, "block int, level byte, cells binary")
    merged = seen.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary")
    packed, width = bytearray(rows << bits >> 3), 1 << BLOCK_BITS >> 3
    for block, data in merged.toLocalIterator():
        packed[block * width : (block + 1) * width] = data
    return Repeats(bits, rows, docs.sparkSession.sparkContext.broadcast(packed))
