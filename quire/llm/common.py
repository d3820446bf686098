"""Shared pieces of the training-data operators: text blocks, word arrays, fingerprints, cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of bytes outside the blank and U+0009 to U+000D.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

U64 = np.uint64
BLOCK_BYTES = 1 << 18


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage. Only a local session may lack one and gets a temporary folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quire-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


#: Most bytes of rows that Spark sends to Python at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what is sent to Python at once by bytes, unless the session bounds it closer; rows with texts can be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("bB")
    if not held.lstrip("-").isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession) -> str:
    """A new table's path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, row_group: int | None = None) -> DataFrame:
    """df, written as a compressed table to the shared checkpoint folder and read back; for wider rows.

    row_group bounds what a task that reads it holds at once, in bytes."""
    spark = df.sparkSession
    path = path or table_path(spark)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> None:
    """Deletes a table that no frame still in use is computed from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Most groups that are broadcast as frequent ones, and the fewest rows that such a group has.
MOST_HOT = 1 << 16
LEAST_HOT = 1000


def hot_bound(groups: DataFrame) -> int:
    """So many rows that at most MOST_HOT of groups (n_rows) have as many; one with fewer is a 65536th of all at most, or small."""
    total = groups.agg(F.sum("n_rows")).first()[0] or 0
    return max(LEAST_HOT, -(-total // MOST_HOT))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (multiply and shift), vectorised."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, base, dtype=U64)
                row[0] = 1
                setattr(self, name, np.cumprod(row))
        return self.up[:n], self.down[:n]


_BYTE = (_Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93))
_SEQ = (_Powers(0xC2B2AE3D27D4EB4F), _Powers(0xA0761D6478BD642F))


class Block:
    """Whole texts of a few rows as one byte array.

    data: bytes of all texts; at: start of each text in data, with the end as last entry.
    start, end: byte range of each word; first: index of each text's first word, with the total as last.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at = data, at
        n = len(data)
        word = IS_WORD[data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        if n:
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = at[(at > 0) & (at < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes and length."""
        up, down = _BYTE[which].upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(U64) * U64(0x9E3779B97F4A7C15)))


def sequence_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of words[i:i+n] for every i, without regard to texts' ends."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    up, down = _SEQ[which].upto(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1])


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """For every i of the first total-n+1 words: whether words i to i+n-1 belong to one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=bool)
    ok = np.zeros(total + 1, dtype=np.int32)
    long = np.flatnonzero(np.diff(first) >= n)
    np.add.at(ok, first[long], 1)
    np.add.at(ok, first[long + 1] - n + 1, -1)
    return np.cumsum(ok)[: total - n + 1] > 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, size: int = BLOCK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in slices of about size bytes of text, whole rows each."""
    if not batch.num_rows:
        return
    _, at = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def blocks(batches: Iterator[pa.RecordBatch], lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        for part in pieces(batch):
            data, at = text_bytes(part.column("text"))
            yield part, Block(LOWER[data] if lower else data, at)


def text_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every text's sequence of words."""
    n = block.n_words.astype(U64)
    out = []
    for which in (0, 1):
        up, down = _SEQ[which].upto(len(block.start) + 1)
        total = np.zeros(len(block.start) + 1, dtype=U64)
        np.cumsum(block.word_hashes(which) * up[: len(block.start)], out=total[1:])
        out.append(mix((total[block.first[1:]] - total[block.first[:-1]]) * down[block.first[:-1]] ^ mix(n)))
    return out[0], out[1]


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"


def plainly_named(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns of docs under names without special characters (text keeps its own), for functions over batches, and these names."""
    inner = [c if c == "text" else f"_c{i}" for i, c in enumerate(names)]
    return docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(names, inner, strict=True)]), inner


def without_month_intervals(docs: DataFrame) -> DataFrame:
    """docs with its intervals of years and months as whole months; Arrow can't carry them."""
    months = lambda c: F.extract(F.lit("YEAR"), c) * 12 + F.extract(F.lit("MONTH"), c.cast("interval year to month"))
    kinds = [isinstance(f.dataType, T.YearMonthIntervalType) for f in docs.schema.fields]
    return docs.select(*[months(F.col(quoted(f.name))).cast("int").alias(f.name) if is_ else F.col(quoted(f.name)) for f, is_ in zip(docs.schema.fields, kinds, strict=True)])


def with_month_intervals(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the columns that without_month_intervals made numbers of as intervals again."""
    kinds = {f.name: f.dataType for f in docs.schema.fields if isinstance(f.dataType, T.YearMonthIntervalType)}
    return rows.select(*[F.make_ym_interval(F.lit(0), F.col(quoted(c))).cast(kinds[c]).alias(c) if c in kinds else F.col(quoted(c)) for c in rows.columns])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def record(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of links (a, b: long): one row (node, root) per linked node, root the smallest node reachable.

    Alternates pointing every node at its smallest neighbour and shortening the paths
    (large-star and small-star), so a hub or a long chain takes a logarithmic number of rounds.
    Each round is cut in the shared checkpoint folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = cut(edges)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u > v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
