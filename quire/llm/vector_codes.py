"""Vector code compression (operator 13): product codes by heap Lloyd, in whole numbers.

Vectors are cut in equal parts; each position has a codebook, learned from all vectors. Every block of vectors keeps,
for each position and entry, a heap of the parts that this entry has, keyed by slack: the lower bound of the distance to any
other entry minus the upper bound of that to its own. When entries move, no bound is touched: an entry's drift (its own way
and the longest of the others) adds up, and a round pops only parts whose key the drift has reached, compares these with all
entries exactly and pushes them again. Keys are rounded down, so a part that stays in its heap surely has the nearest entry,
ties included; distances are compared as whole numbers.

Blocks live in tables of the shared folder, one written a round and the one before deleted; a task adds up what its
blocks' parts changed and sends at most entries * (dimensions + parts) sums. The codebooks (as many numbers) are all that
reaches the driver and every task. A group's errors (label_error) go back to its rows by broadcast for groups of at least
1/65536 of the rows, 65536 at most, and by a shuffled join for the smaller rest.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; vectors of another length
than the smallest id's, and all if that is 0 or no multiple of the parts, have code and error null and teach nothing; a null id
comes after all others; rows that repeat an id are vectors of their own, ordered by their components; with fewer vectors than
entries there are as many entries as vectors; equal entries tie, the lower has all; an empty table gives an empty result; other
columns of any name and type are kept unchanged. Components so large that an error would not fit a long end the job with an error.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import forgotten, hot_bound, quoted, record, small_batches, stored, table_path

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block; places in it have two bytes.
BLOCK_ROWS = 4096
#: Bytes of blocks that a task reads at once.
ROW_GROUP = 16 << 20
#: Keys are lowered by this share of the distances, far more than these can be rounded.
MARGIN = 1e-9


def usable(column: str) -> F.Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


@dataclass
class Books:
    """Codebooks (parts, entries, components), their drift since the start (parts, entries) and parts per entry."""

    entries: np.ndarray
    drift: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def started(cls, seeds: np.ndarray, parts: int) -> Books:
        entries = np.ascontiguousarray(seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
        return cls(entries, np.zeros(entries.shape[:2]), np.zeros_like(entries), np.zeros(entries.shape[:2], dtype=np.int64))

    def moved(self, changes: list[tuple[int, int]]) -> Books:
        """After a round whose parts changed sums and counts by changes (place, number)."""
        flat = np.zeros(self.sums.size + self.counts.size, dtype=np.int64)
        for place, n in changes:
            flat[place] = n
        sums = self.sums + flat[: self.sums.size].reshape(self.sums.shape)
        counts = self.counts + flat[self.sums.size :].reshape(self.counts.shape)
        entries = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        way = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        if way.shape[1] > 1:
            longest, second = np.sort(way, axis=1)[:, -1:], np.sort(way, axis=1)[:, -2:-1]
            first = np.arange(way.shape[1]) == way.argmax(axis=1)[:, None]
            way = way + np.where(first, second, longest)
        return Books(entries, (self.drift + way) * (1 + MARGIN), sums, counts)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to entries, exact: in doubles only where all sums are whole numbers below 2**53."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, the lowest of equal ones, and its slack, rounded down."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    if d.shape[1] == 1:
        return code, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return code, two[:, 1] - two[:, 0] - MARGIN * (two.sum(axis=1) + 1)


def rounded_down(keys: np.ndarray) -> np.ndarray:
    short = keys.astype(np.float32)
    return np.where(short > keys, np.nextafter(short, np.float32(-np.inf)), short)


class Heaps:
    """A block's heaps: (key, place) of every part, by position and entry."""

    def __init__(self, parts: int, entries: int) -> None:
        self.shape = parts, entries
        self.own: list[list[tuple[float, int]]] = [[] for _ in range(parts * entries)]

    @classmethod
    def of(cls, parts: int, entries: int, keys: bytes, places: bytes, counts: bytes) -> Heaps:
        out = cls(parts, entries)
        k, p = np.frombuffer(keys, np.float32).tolist(), np.frombuffer(places, np.uint16).tolist()
        begin = 0
        for i, n in enumerate(np.frombuffer(counts, np.uint16).tolist()):
            out.own[i] = list(zip(k[begin : begin + n], p[begin : begin + n], strict=True))
            begin += n
        return out

    def packed(self) -> tuple[bytes, bytes, bytes]:
        all_ = [x for h in self.own for x in h]
        return np.array([k for k, _ in all_], np.float32).tobytes(), np.array([p for _, p in all_], np.uint16).tobytes(), np.array([len(h) for h in self.own], np.uint16).tobytes()

    def popped(self, part: int, entry: int, drift: float) -> list[int]:
        """Places of the parts whose bounds the drift has reached; the others aren't looked at."""
        heap, out = self.own[part * self.shape[1] + entry], []
        while heap and heap[0][0] <= drift:
            out.append(heapq.heappop(heap)[1])
        return out

    def push(self, part: int, codes: np.ndarray, keys: np.ndarray, places: np.ndarray) -> None:
        for e, k, p in zip(codes.tolist(), rounded_down(keys).tolist(), places.tolist(), strict=True):
            heapq.heappush(self.own[part * self.shape[1] + e], (k, p))

    def fill(self, part: int, codes: np.ndarray, keys: np.ndarray) -> None:
        """The heaps of a position at once: sorted lists are heaps."""
        by = np.lexsort((keys, codes))
        pairs = list(zip(rounded_down(keys)[by].tolist(), by.tolist(), strict=True))
        ends = np.searchsorted(codes[by], np.arange(self.shape[1] + 1)).tolist()
        for e in range(self.shape[1]):
            self.own[part * self.shape[1] + e] = pairs[ends[e] : ends[e + 1]]

    def codes(self, n: int) -> np.ndarray:
        out = np.zeros((self.shape[0], n), dtype=np.uint8 if self.shape[1] <= 256 else np.uint16)
        for i, heap in enumerate(self.own):
            out[i // self.shape[1], [p for _, p in heap]] = i % self.shape[1]
        return out


class Changes:
    """What a task's parts change of an entry's sums and counts."""

    def __init__(self, books: Books) -> None:
        self.sums, self.counts = np.zeros_like(books.sums), np.zeros_like(books.counts)

    def add(self, part: int, codes: np.ndarray, x: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], codes, sign * x)
        np.add.at(self.counts[part], codes, sign)

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([self.sums.ravel(), self.counts.ravel()])
        held = np.flatnonzero(flat)
        return held.astype(np.int32), flat[held]


def assigned(x: np.ndarray, books: Books, heaps: Heaps | None, changes: Changes | None) -> tuple[Heaps, int]:
    """Heaps of a block's parts x (parts, rows, components) for the entries now, and how many parts were compared."""
    parts, n = x.shape[:2]
    compared = 0
    if heaps is None:
        heaps = Heaps(parts, books.entries.shape[1])
        for p in range(parts):
            codes, slack = nearest(x[p], books.entries[p])
            heaps.fill(p, codes, slack + books.drift[p][codes])
            if changes:
                changes.add(p, codes, x[p], 1)
        return heaps, parts * n
    for p in range(parts):
        out = [heaps.popped(p, e, d) for e, d in enumerate(books.drift[p].tolist())]
        places = np.array([i for o in out for i in o], dtype=np.int64)
        if not len(places):
            continue
        before = np.repeat(np.arange(len(out)), [len(o) for o in out])
        codes, slack = nearest(x[p][places], books.entries[p])
        heaps.push(p, codes, slack + books.drift[p][codes], places)
        compared += len(places)
        new = codes != before
        if changes and new.any():
            changes.add(p, before[new], x[p][places[new]], -1)
            changes.add(p, codes[new], x[p][places[new]], 1)
    return heaps, compared


BLOCK = "n int, ints binary, keys binary, places binary, counts binary, compared long, k int, v long"


class Codes:
    """The rows of a table of vectors in blocks, and their codebooks."""

    def __init__(self, vectors: DataFrame, column: str, id_column: str, parts: int, entries: int) -> None:
        self.spark, self.parts = vectors.sparkSession, parts
        small_batches(self.spark)
        self.fields = [f for f in vectors.schema.fields if f.name != column]
        self.inner = [f"_c{i}" for i in range(len(self.fields))]
        kept = vectors.where(usable(quoted(column)))
        rows = kept.select(*[F.col(quoted(f.name)).alias(c) for f, c in zip(self.fields, self.inner, strict=True)], F.col(quoted(column)).cast("array<double>").alias("x"))
        id_ = self.inner[[f.name for f in self.fields].index(id_column)]
        order = F.struct(F.col(id_).isNull(), F.col(id_), "x")
        first = rows.agg(F.min_by(F.size("x"), order).alias("n"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v * SCALE)))).alias("most")).first()
        self.dim = first["n"] or 0
        fits = F.lit(self.dim > 0 and self.dim % parts == 0) & (F.size("x") == self.dim)
        self.rows, self.others = rows.where(fits), rows.where(~fits)
        most = math.ceil(min(first["most"] or 0.0, 1e30))
        if 4 * most * most * max(1, self.dim) >= 1 << 63:
            raise ValueError("components are so large that squared distances don't fit a long")
        self.kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if most < np.iinfo(k).max)
        seeds = [r["x"] for r in self.rows.orderBy(F.col(id_).asc_nulls_last(), "x").limit(entries).collect()]  # as many as entries
        self.books = Books.started(np.floor(np.array(seeds, dtype=np.float64).reshape(len(seeds), self.dim) * SCALE).astype(np.int64), parts) if seeds else None
        self.table, self.path = None, None

    def _shaped(self, ints: np.ndarray) -> np.ndarray:
        """(rows, dimensions) as (parts, rows, components) of 64 bits."""
        return ints.astype(np.int64).reshape(len(ints), self.parts, -1).transpose(1, 0, 2)

    def _blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, tuple | None]]:
        """Columns as lists, whole numbers and packed heaps of every block; of plain rows the heaps are None."""
        if "x" in batch.schema.names:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(begin, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, self.dim)
                yield [part.column(c) for c in self.inner], np.floor(x * SCALE).astype(self.kind), None
            return
        for i, n in enumerate(batch.column("n").to_pylist()):
            ints = np.frombuffer(batch.column("ints")[i].as_py(), self.kind).reshape(n, self.dim)
            yield [batch.column(c)[i].values for c in self.inner], ints, tuple(batch.column(c)[i].as_py() for c in ("keys", "places", "counts"))

    def _rows(self) -> DataFrame:
        return self.rows if self.table is None else self.table.where("k IS NULL").select(*self.inner, "n", "ints", "keys", "places", "counts")

    def _heaps(self, held: tuple | None, books: Books) -> Heaps | None:
        return None if held is None else Heaps.of(self.parts, books.entries.shape[1], *held)

    def _detached(self) -> Codes:
        """What tasks need of self."""
        out = object.__new__(Codes)
        out.parts, out.inner, out.dim, out.kind = self.parts, self.inner, self.dim, self.kind
        return out

    def turn(self) -> int:
        """One round: assigns all parts, then moves the entries. How many parts were compared with all entries."""
        books, inner, me = self.books, self.inner, self._detached()
        lists = [T.StructField(c, T.ArrayType(f.dataType)) for c, f in zip(inner, self.fields, strict=True)]
        schema = T.StructType(lists + list(T._parse_datatype_string(BLOCK).fields))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            changes = Changes(books)
            types = None
            for batch in batches:
                for columns, ints, held in me._blocks(batch):
                    heaps, compared = assigned(me._shaped(ints), books, me._heaps(held, books), changes)
                    own = [pa.ListArray.from_arrays(pa.array([0, len(ints)], pa.int32()), c) for c in columns]
                    types = [c.type for c in own]
                    one = [[len(ints)], [ints.tobytes()], *[[x] for x in heaps.packed()], [compared], [None], [None]]
                    kinds = (pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int32(), pa.int64())
                    yield record([*inner, *NAMES], [*own, *[pa.array(x, t) for x, t in zip(one, kinds, strict=True)]])
            if types is not None:
                k, v = changes.listed()
                none = lambda t: pa.nulls(len(k), t)
                yield record([*inner, *NAMES], [*map(none, types), none(pa.int32()), *[none(pa.binary())] * 4, none(pa.int64()), pa.array(k), pa.array(v)])

        path = table_path(self.spark)
        table = stored(self._rows().mapInArrow(work, schema), path, ROW_GROUP)
        sums = table.where("k IS NOT NULL").groupBy("k").agg(F.sum("v").alias("v"))
        self.books = books.moved([tuple(r) for r in sums.collect()])  # as many as the codebooks have numbers
        if self.path:
            forgotten(self.spark, self.path)
        self.table, self.path = table, path
        return table.agg(F.sum("compared")).first()[0] or 0

    def coded(self) -> DataFrame:
        """The input's rows with code, error and (of blocks) nothing of the vectors."""
        schema = T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(self.inner, self.fields, strict=True)], T.StructField("_code", T.StringType()), T.StructField("_error", T.LongType())])
        books, inner, me = self.books, self.inner, self._detached()
        others = self.others.select(*inner, F.lit(None).cast("string").alias("_code"), F.lit(None).cast("long").alias("_error"))
        if books is None:
            return others

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for columns, ints, held in me._blocks(batch):
                    x, n = me._shaped(ints), len(ints)
                    heaps, _ = assigned(x, books, me._heaps(held, books), None)
                    codes = heaps.codes(n)
                    error = np.zeros(n, dtype=np.int64)
                    for p in range(me.parts):
                        error += ((x[p] - books.entries[p][codes[p]]) ** 2).sum(axis=1)
                    text = np.ascontiguousarray(codes.T).astype(">u2" if codes.dtype == np.uint16 else "u1").tobytes().hex()
                    width = len(text) // max(1, n)
                    yield record([*inner, "_code", "_error"], [*columns, pa.array([text[i * width : (i + 1) * width] for i in range(n)]), error])

        return self._rows().mapInArrow(work, schema).unionByName(others)

    def digest(self) -> str:
        entries = [] if self.books is None else self.books.entries.ravel().tolist()
        return hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest()


NAMES = [f.split()[0] for f in BLOCK.split(", ")]


def compressed(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codes]:
    """vectors without column, with code and error (any of these names are replaced), and the codebooks; see the module's text."""
    vectors = vectors.select(*[F.col(quoted(c)) for c in vectors.columns if c not in ("code", "error")])
    codes = Codes(vectors, column, id_column, parts, entries)
    if codes.books is not None:
        for _ in range(rounds):
            codes.turn()
    rows = codes.coded()
    return rows.select(*[F.col(c).alias(f.name) for c, f in zip(codes.inner, codes.fields, strict=True)], F.col("_code").alias("code"), F.col("_error").alias("error")), codes


def with_group_errors(rows: DataFrame, group: str, name: str) -> DataFrame:
    """rows with the sum of error over rows of an equal group, nulls being one."""
    rows = stored(rows)
    key = F.col(quoted(group))
    per = stored(rows.groupBy(key.alias("_g")).agg(F.sum("error").alias(name), F.count("*").alias("n_rows")))
    bound = hot_bound(per)
    hot = F.broadcast(per.where(F.col("n_rows") >= bound).drop("n_rows"))
    cold = per.where(F.col("n_rows") < bound).drop("n_rows")
    same = key.eqNullSafe(F.col("_g"))
    many = rows.join(hot, same).drop("_g")
    few = rows.join(hot, same, "left_anti").join(cold, same).drop("_g")
    return many.unionByName(few)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows, codes = compressed(vectors)
    out = with_group_errors(rows, "label", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
