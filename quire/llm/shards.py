"""Distinct texts dealt into chunks, and how many of them hold each n-gram, counted in shards of the hash range.

No sketch is broadcast. Texts travel once, compressed, to the chunk that their words' fingerprint names, so equal texts
meet; every task passes on one of its own equal texts only, and a text that a third of all rows hold reaches its chunk at
most once a task. A chunk sends the sorted cells of its n-grams to their shards, as gaps; a shard adds up what all chunks
sent and answers each chunk with one level (a rounded logarithm of the count) a cell. Chunks and shards have a fixed size
and their number follows the corpus (a chunk's message to a shard holds CHUNK_WORDS * SHARD_CELLS / words cells, some 60 at
10**10 words; far beyond that it nears a row a cell), and so does the number of cells (CELL_BITS more than n-grams): the share of n-grams
that a full cell makes look more frequent than they are is about 1 in 2**CELL_BITS at every size. Counts are never too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import U64, Block, blocks, quoted, record, signed, small_batches, text_hashes

#: Words of a chunk of texts, and cells of a shard, on average.
CHUNK_WORDS = 500_000
SHARD_CELLS = 1 << 20
CELL_BITS = 6
#: Levels to a doubling of the count; level 0 is a count of one.
STEPS = 4
#: Bytes of rows that a task holds before it passes them on.
HELD_BYTES = 8 << 20

Items = Callable[[Block], tuple[np.ndarray, np.ndarray]]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; high planes that are all zero take no room."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()


def sealed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def opened(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in column.to_pylist()])


class Dealer:
    """Rows held by a task until they are passed on, sealed, a record for each chunk."""

    def __init__(self, chunks: int) -> None:
        self.chunks, self.parts, self.bytes = chunks, [], 0

    def add(self, batch: pa.RecordBatch, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            self.parts.append((batch, (key % U64(self.chunks)).astype(np.int32)))
            self.bytes += batch.nbytes
        if self.bytes >= HELD_BYTES:
            yield from self.dealt()

    def dealt(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        rows, chunk = pa.Table.from_batches([b for b, _ in self.parts]), np.concatenate([c for _, c in self.parts])
        self.parts, self.bytes = [], 0
        by = np.argsort(chunk, kind="stable")
        at = np.flatnonzero(np.diff(chunk[by], prepend=-1)).tolist()
        for b, e in zip(at, [*at[1:], len(by)], strict=True):
            yield record(["chunk", "data"], [chunk[by[b : b + 1]], pa.array([sealed(rows.take(pa.array(by[b:e])))], pa.binary())])


def dealt_texts(docs: DataFrame, chunks: int, lower: bool) -> DataFrame:
    """(chunk, data): one text at least of each sequence of words, none without words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = Dealer(chunks), set()
        for part, block in blocks(batches, lower):
            f1, f2 = text_hashes(block)
            keep = []
            for i, (n, *key) in enumerate(zip(block.n_words.tolist(), f1.tolist(), f2.tolist(), strict=True)):
                if n and tuple(key) not in seen:
                    seen.add(tuple(key))
                    keep.append(i)
            yield from dealer.add(record(["f1", "f2", "text"], [signed(f1[keep]), signed(f2[keep]), part.column("text").take(pa.array(keep, pa.int64()))]), f1[keep])
        yield from dealer.dealt()

    return docs.select("text").mapInArrow(deal, "chunk int, data binary")


def distinct(table: pa.Table, k1: str, k2: str) -> pa.Table:
    """table in the order of its keys, without repeated ones."""
    a, b = (table.column(c).to_numpy() for c in (k1, k2))
    by = np.lexsort((b, a))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (a[by[1:]] != a[by[:-1]]) | (b[by[1:]] != b[by[:-1]])
    return table.take(pa.array(by[new]))


def chunk_items(table: pa.Table, items: Items, lower: bool) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The chunk's distinct texts (f1, f2), their items' hashes, and how many each text has."""
    texts = distinct(opened(table.column("data")), "f1", "f2")
    found = [items(block) for _, block in blocks(iter(texts.select(["text"]).to_batches()), lower)]
    return texts.select(["f1", "f2"]), np.concatenate([x for x, _ in found]), np.concatenate([np.diff(at) for _, at in found])


def cells_of(grams: np.ndarray, bits: int) -> np.ndarray:
    return grams >> U64(64 - bits)


class Counts:
    """Texts of docs, and the levels of their items (distinct in a text), by chunk."""

    def __init__(self, docs: DataFrame, words: int, items: Items, lower: bool = False, chunk_words: int = CHUNK_WORDS) -> None:
        small_batches(docs.sparkSession)
        self.items, self.lower = items, lower
        self.bits = min(56, max(8, int(words).bit_length() + CELL_BITS))
        self.shard_bits = max(0, min(30, self.bits - CELL_BITS - (SHARD_CELLS.bit_length() - 1)))
        self.texts = dealt_texts(docs, max(1, -(-words // chunk_words)), lower)

    def levels(self) -> DataFrame:
        """(chunk, shard, levels): a byte for each distinct cell of a chunk in a shard, in their order."""
        items, lower, bits, down = self.items, self.lower, self.bits, self.bits - self.shard_bits

        def send(table: pa.Table) -> pa.Table:
            _, grams, _ = chunk_items(table, items, lower)
            cells, n = np.unique(cells_of(grams, bits), return_counts=True)
            shard = (cells >> U64(down)).astype(np.int32)
            at = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            ends = [*at[1:], len(cells)]
            gaps = [packed(np.diff(cells[b:e], prepend=U64(0))) for b, e in zip(at, ends, strict=True)]
            counts = [packed(n[b:e]) for b, e in zip(at, ends, strict=True)]
            chunk = pa.array(np.full(len(at), table.column("chunk")[0].as_py(), np.int32))
            return pa.table({"shard": pa.array(shard[at]), "chunk": chunk, "gaps": pa.array(gaps, pa.binary()), "counts": pa.array(counts, pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            sent = [np.cumsum(unpacked(x)) for x in table.column("gaps").to_pylist()]
            counts = np.concatenate([unpacked(x) for x in table.column("counts").to_pylist()]).astype(np.float64)
            _, back = np.unique(np.concatenate(sent), return_inverse=True)
            total = np.bincount(back, weights=counts)
            level = np.rint(STEPS * np.log2(total)).clip(0, 127).astype(np.uint8)[back]
            ends = np.cumsum([len(x) for x in sent]).tolist()
            out = [pa.compress(level[b:e].tobytes(), codec="zstd", asbytes=True) for b, e in zip([0, *ends[:-1]], ends, strict=True)]
            return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "cells": pa.array([len(x) for x in sent], pa.int32()), "levels": pa.array(out, pa.binary())})

        sent = self.texts.groupBy("chunk").applyInArrow(send, "shard int, chunk int, gaps binary, counts binary")
        return sent.groupBy("shard").applyInArrow(add, "chunk int, shard int, cells int, levels binary")

    def answered(self, work: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
        """work on every chunk: its distinct texts (f1, f2), how many items each has, the items' hashes and levels."""
        items, lower, bits = self.items, self.lower, self.bits

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            texts, grams, size = chunk_items(left, items, lower)
            right = right.sort_by("shard")
            level = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True), np.uint8) for n, x in zip(right.column("cells").to_pylist(), right.column("levels").to_pylist(), strict=True)])
            return work(texts, size, grams, level[np.unique(cells_of(grams, bits), return_inverse=True)[1]])

        return self.texts.groupBy("chunk").cogroup(self.levels().groupBy("chunk")).applyInArrow(answer, schema)


def hashable(field: T.StructField) -> Column:
    """A column as xxhash64 takes it: one that holds maps or variants anywhere goes as JSON."""
    names = field.dataType.json()
    return F.to_json(F.struct(F.col(quoted(field.name)))) if '"map"' in names or "variant" in names else F.col(quoted(field.name))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """docs with _quire_r1, _quire_r2: two hashes of the whole row; rows that are equal in all columns share them."""
    columns = [hashable(f) for f in docs.schema.fields]
    return docs.select("*", F.xxhash64(*columns).alias("_quire_r1"), F.xxhash64(F.lit(0x51ED), *columns).alias("_quire_r2"))


def chosen_rows(docs: DataFrame, keys: DataFrame, chunks: int) -> DataFrame:
    """Of the rows of docs (see keyed_rows) whose keys are in keys (_quire_r1, _quire_r2) one of each.

    Rows travel once, compressed, to the chunk that their key names; of equal rows every task passes on one only."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    inner = [f"_d{i}" for i in range(len(schema.fields))]
    names = ["_quire_r1", "_quire_r2"]
    rows = keyed_rows(docs).toDF(*inner, *names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, seen = Dealer(chunks), set()
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            own = batch.take(pa.array(keep, pa.int64()))
            yield from dealer.add(own, own.column(names[0]).to_numpy().view(U64))
        yield from dealer.dealt()

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        own = opened(left.column("data"))
        wanted = set(zip(*(right.column(c).to_pylist() for c in names), strict=True))
        keep = []
        for i, key in enumerate(zip(*(own.column(c).to_pylist() for c in names), strict=True)):
            if key in wanted:
                wanted.remove(key)
                keep.append(i)
        return own.take(pa.array(keep, pa.int64())).select(inner).rename_columns(types.names)

    types = to_arrow_schema(schema)
    dealt = rows.mapInArrow(deal, "chunk int, data binary")
    listed = keys.withColumn("chunk", _chunk(F.col("_quire_r1"), chunks))
    return dealt.groupBy("chunk").cogroup(listed.groupBy("chunk")).applyInArrow(choose, schema)


def _chunk(key: Column, chunks: int) -> Column:
    """The unsigned key modulo chunks."""
    high, low = F.shiftrightunsigned(key, 1), key.bitwiseAND(F.lit(1))
    return F.pmod(F.pmod(high, F.lit(chunks)) * 2 + low, F.lit(chunks)).cast("int")
