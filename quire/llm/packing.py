"""Best-fit packing by exact-complement hashing (operator 8).

Every document is tokenised once; only (doc_id, piece, start, length, checksum) goes on. The plan is made from the
histogram of piece lengths, which has at most one entry per length (2048), whatever the corpus: it is a list of
patterns (how many pieces of which lengths fill a sequence) with multiplicities. Pieces then find their places by
their rank among pieces of equal length, so no sequence and no group is ever gathered in one task.

Defined results: a null text is an empty one (a single id 0); very long texts are cut as stated; rows that repeat a
doc_id are documents of their own, and rows equal in every column are interchangeable; an empty table gives an empty
result; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import cut, record, small_batches
from quire.llm.common import pieces as slices

CAPACITY = 2048
END_ID = 0
#: Pieces of one length are ranked within buckets of about so many rows.
BUCKET_ROWS = 50_000


class Tokens:
    """ids of the tokenizer in a file of the tokenizers library.

    A byte-level BPE whose ids follow its merges is run by tiktoken from the same file's vocabulary, which gives the
    same ids several times faster; texts with a special token's string, and any other tokenizer, go to the library.
    """

    def __init__(self, path: str) -> None:
        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._same(spec)

    @property
    def whole(self):
        """The library's tokenizer, loaded when a text first needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _same(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not plain or spec.get("normalizer") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        # the printable stand-ins of byte-level BPE: visible Latin-1 characters stand for themselves, the rest from U+0100 on
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if ids != sorted(ids) or any(t not in byte for t, i in model["vocab"].items() if len(t) == 1):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        if any(len(k) > 1 and v < ids[0] for k, v in ranks.items()) or len(ranks) != 256 + len(ids):
            return None
        # the split that the library's ByteLevel pre-tokenizer fixes
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: all full but the first."""
    head = n % capacity
    return [head] * (head > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its ids if asked for."""
    small_batches(docs.sparkSession)
    doc_id = docs.schema["doc_id"]
    fields = f"doc_id {doc_id.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(tokenizer)
        for batch in batches:
            for part in slices(batch):
                row, piece, start, length, crc, out = [], [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(coder.ids(text or ""), np.array([END_ID], dtype="<u4")).astype("<u4", copy=False)
                    at = 0
                    for k, n in enumerate(cut_lengths(len(ids), capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                        if with_ids:
                            out.append(ids[at : at + n].astype(np.int32))
                        at += n
                columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield record(names + ["ids"] * with_ids, columns + [pa.array(out, pa.list_(pa.int32()))] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(split, fields)


class Plan:
    """Places of the pieces of each length, by rank among them."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity, self.left = capacity, np.zeros(capacity + 1, dtype=np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.patterns: list[tuple[dict[int, int], int]] = []
        for n in range(capacity, 0, -1):
            while self.left[n]:
                self._fill(n)
        self._index()

    def _have(self, need: dict[int, int], more: list[int]) -> bool:
        total = dict(need)
        for n in more:
            total[n] = total.get(n, 0) + 1
        return all(self.left[n] >= c for n, c in total.items())

    def _exact(self, need: dict[int, int], gap: int) -> list[int] | None:
        """One, two or three pieces left over that fill gap exactly, the largest first."""
        free = self.left > 0
        if free[gap] and self._have(need, [gap]):
            return [gap]
        for a in self._pairs(free, gap):
            if self._have(need, [a, gap - a]):
                return [a, gap - a]
        for a in np.flatnonzero(free[: gap - 1])[::-1]:
            for b in self._pairs(free, gap - int(a)):
                if b <= a and self._have(need, [int(a), b, gap - int(a) - b]):
                    return [int(a), b, gap - int(a) - b]
            if 3 * a < gap:
                break
        return None

    @staticmethod
    def _pairs(free: np.ndarray, total: int) -> Iterator[int]:
        """Larger halves of pairs of lengths left over that sum to total, the largest first."""
        if total < 2:
            return
        low = (total + 1) // 2
        both = free[low:total] & free[total - low : 0 : -1]
        for a in np.flatnonzero(both)[::-1]:
            yield low + int(a)

    def _fill(self, n: int) -> None:
        need, gap = {n: 1}, self.capacity - n
        while gap:
            more = self._exact(need, gap)
            if more is None:  # best fit: the largest piece that goes in
                fits = [int(a) for a in np.flatnonzero(self.left[: gap + 1])[::-1] if self.left[a] > need.get(int(a), 0)][:1]
                if not fits:
                    break
                more = fits
            for a in more:
                need[a] = need.get(a, 0) + 1
                gap -= a
        times = min(int(self.left[a]) // c for a, c in need.items())
        for a, c in need.items():
            self.left[a] -= c * times
        self.patterns.append((need, times))

    def _index(self) -> None:
        used = dict.fromkeys(range(self.capacity + 1), 0)
        rows, sequence = [], 0
        for need, times in self.patterns:
            offset = 0
            for n, c in need.items():
                rows.append((n, used[n], c, sequence, offset))
                used[n] += c * times
                offset += c * n
            sequence += times
        self.sequences = sequence
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.key = table[:, 0] << 48 | table[:, 1]
        self.first, self.each, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def placed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """made (pieces, already cut from their lineage) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)
    buckets = max(256, sum(counts.values()) // BUCKET_ROWS)
    rows = made.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    group = W.partitionBy("length", "_bucket")
    rows = rows.withColumn("_nth", F.row_number().over(group.orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    sizes = made.select("length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int").alias("_bucket")).groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    ahead = sizes.select("length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_ahead"))
    ranked = rows.join(ahead, ["length", "_bucket"]).select(*made.columns, (F.col("_nth") + F.col("_ahead")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = plan.places(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
                keep = [n for n in batch.schema.names if n != "_rank"]
                yield record([*keep, "sequence_id", "offset"], [*(batch.column(n) for n in keep), sequence, offset])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs' pieces with their places in sequences of at most capacity ids."""
    return placed(cut(pieces(docs, tokenizer or default_tokenizer(), capacity, with_ids)), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
