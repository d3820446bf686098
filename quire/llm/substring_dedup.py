"""Substring dedup with a count-min prefilter (operator 1).

A window is n consecutive words of one document. First pass: every window has an anchor, the leftmost of its smallest
grams of a few words; the anchors' occurrences (about one in seven words) are sketched, task by task, and merged.
Equal windows have equal anchors at different places, so an anchor's estimate is never below its windows' counts.
Second pass: windows whose anchor is estimated as repeated are grouped exactly by a 128-bit fingerprint of their words.
Within a task only the first of equal windows goes on, the rest is known to be repeated already; so a window that
a third of all documents share reaches its group once per chunk of a task, however common it is.

Defined results: a null text has no words; rows without doc_id come before all others and are told apart by 127 bits of
their texts' hashes, which also order them; rows that repeat a doc_id with the same text are one document (each gets that
document's result), with another text they are ordered by 63 bits of its hash; ids that aren't whole numbers are ordered by a
64-bit hash; texts of any length are read whole; an empty table gives an empty result; other columns are kept unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import U64, Block, blocks, inside, mix, quoted, record, sequence_hashes, signed
from quire.llm.sketch import Repeats, repeats

WINDOW = 20
GRAM = 8
#: Candidate windows that a task holds at a time.
CHUNK_WINDOWS = 700_000


def anchors(words: np.ndarray, first: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' starts, for each the place of its anchor, and the hash of the gram at every place."""
    ok = np.flatnonzero(inside(first, n))
    grams = sequence_hashes(words, gram)
    if not len(ok):
        return ok, ok, grams
    span = n - gram + 1
    low, width = grams, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    least = np.minimum(low[ok], low[ok + span - width])
    place = ok + span - 1
    for j in range(span - 2, -1, -1):
        at = ok + j
        np.copyto(place, at, where=grams[at] == least)
    return ok, place, grams


def anchor_items(n: int, gram: int):
    def items(block: Block) -> np.ndarray:
        _, place, grams = anchors(block.word_hashes(), block.first, n, gram)
        return grams[np.unique(place)]

    return items


#: Set in a place: a run of windows known to be repeated, whose last start stands for the second fingerprint.
DIRECT = 1 << 31
ROWS = "h1 long, h2 long, id long, th long, place long"


def known_runs(doc: np.ndarray, text: np.ndarray, start: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Runs of windows known to be repeated, among candidate windows."""
    own = mix(mix(doc.view(U64) ^ mix(start.astype(U64))) + text.view(U64))
    return record(["h1", "h2", "id", "th", "place"], [signed(own), last.astype(np.int64), doc, text, start.astype(np.int64) | DIRECT])


class Chunk:
    """Candidate windows held by a task until they are deduplicated among themselves."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def drain(self, n: int) -> Iterator[pa.RecordBatch]:
        """First windows, to be compared with other tasks', and runs of windows repeated here (direct)."""
        h1, h2, doc, text, start = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        by = np.lexsort((start, text, doc, text >= 0, h2, h1))
        h1, h2, doc, text, start = (x[by] for x in (h1, h2, doc, text, start))
        new = np.ones(len(h1), dtype=bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (text != text[head]) | (start != start[head])
        yield record(["h1", "h2", "id", "th", "place"], [signed(h1[new]), signed(h2[new]), doc[new], text[new], start[new].astype(np.int64)])
        if later.any():
            doc, text, start = doc[later], text[later], start[later]
            by = np.lexsort((start, text, doc))
            doc, text, start = doc[by], text[by], start[by]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(doc)) - 1
            yield known_runs(doc[begin], text[begin], start[begin], start[end])


def repeated_windows(keyed: DataFrame, n: int, gram: int, found: Repeats) -> DataFrame:
    """(id, th, run): runs of windows of keyed (id, th, text) whose words also start earlier; a run is last << 32 | start."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for part, block in blocks(batches):
            words = block.word_hashes()
            starts, place, grams = anchors(words, block.first, n, gram)
            if not len(starts):
                continue
            each, back = np.unique(place, return_inverse=True)
            starts = starts[found.of(grams[each])[back]]
            if not len(starts):
                continue
            row = np.searchsorted(block.first, starts, side="right") - 1
            h1 = sequence_hashes(words, n)[starts]
            h2 = sequence_hashes(block.word_hashes(1), n, 1)[starts]
            chunk.add(h1, h2, part.column("id").to_numpy()[row], part.column("th").to_numpy()[row], (starts - block.first[row]).astype(np.int32))
            if chunk.size >= CHUNK_WINDOWS:
                yield from chunk.drain(n)
        if chunk.size:
            yield from chunk.drain(n)

    rows = keyed.mapInArrow(candidates, ROWS)
    return later_windows(rows)


def later_windows(rows: DataFrame) -> DataFrame:
    """(id, th, run) of all but the first of equal windows among rows (see ROWS) that chunks passed on."""
    # a run and a window never share a group: only a run's place has the mark
    direct = F.col("place").bitwiseAND(F.lit(DIRECT)) != 0
    nth = F.rank().over(W.partitionBy("h1", "h2", direct).orderBy(*document_order(), "place"))
    start = F.col("place").bitwiseAND(F.lit(DIRECT - 1))
    last = F.when(direct, F.col("h2")).otherwise(start)
    found = rows.withColumn("nth", nth).where(direct | (F.col("nth") > 1))
    return found.select("id", "th", F.shiftleft(last, 32).bitwiseOR(start).alias("run"))


def key_columns(docs: DataFrame) -> tuple[Column, Column]:
    """A document's id and th. th is 63 bits of the text's hash, below 0 where there is no id; then id is a second hash."""
    kind, given, no_id = docs.schema["doc_id"].dataType, F.col("doc_id"), F.col("doc_id").isNull()
    whole = given.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(given.cast("string"))
    short = F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1))
    return F.when(no_id, F.xxhash64(F.lit(0x51ED), F.col("text"))).otherwise(whole), F.when(no_id, short.bitwiseOR(F.lit(-(1 << 63)))).otherwise(short)


def document_order() -> list[Column]:
    """Documents without id come first."""
    return [F.col("th") >= 0, F.col("id"), F.col("th")]


def keys(docs: DataFrame) -> DataFrame:
    own, th = key_columns(docs)
    return docs.select(own.alias("id"), th.alias("th"), "text")


def removed(docs: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed (word ranges, end exclusive): words of runs' windows are cut out.

    Columns of these names that docs has are replaced.
    """
    new = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("removed", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in dict(new)]
    own_id, own_th = key_columns(docs)
    own = docs.select(*[F.col(quoted(f.name)).alias(f"_d{i}") for i, f in enumerate(kept)], F.col("text").alias("text"), own_id.alias("_id"), own_th.alias("_th"))
    per = runs.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("run").alias("_runs"))
    names = [f"_d{i}" for i, f in enumerate(kept) if f.name != "text"]
    joined = own.join(per, ["_id", "_th"], "left").select(*names, "text", "_runs")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(a, t) for a, t in new])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches):
            flags = np.zeros(int(block.first[-1]) + 1, dtype=np.int32)
            runs = part.column("_runs")
            at = np.repeat(block.first[:-1], np.diff(_offsets(runs)))
            if len(at):
                run = runs.flatten().to_numpy()
                np.add.at(flags, at + (run & 0xFFFFFFFF), 1)
                np.add.at(flags, at + (run >> 32) + n, -1)
            keep = np.cumsum(flags)[:-1] == 0
            out = dict(zip([f.name for f in kept if f.name != "text"], (part.column(c) for c in names), strict=True))
            out["text"] = part.column("text")
            n_removed = block.n_words - np.diff(np.concatenate([[0], np.cumsum(keep)])[block.first])
            arrays = [out[f.name] for f in kept] + [block.n_words, n_removed, without(block, keep), _ranges(block, keep)]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=[f.name for f in schema.fields])

    return joined.mapInArrow(cut_out, schema)


def _offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a list array into its flattened values; null counts as empty."""
    sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def _ranges(block: Block, keep: np.ndarray) -> pa.Array:
    out = [""] * (len(block.first) - 1)
    gone = np.concatenate([[True], keep, [True]])
    begin = np.flatnonzero(gone[:-1] & ~gone[1:])
    end = np.flatnonzero(~gone[:-1] & gone[1:])
    if len(begin):
        # a run may go on into the next text
        inner = block.first[np.searchsorted(block.first, begin, side="right")]
        while (over := end > inner).any():
            begin, end = np.concatenate([begin, inner[over]]), np.concatenate([np.where(over, inner, end), end[over]])
            by = np.argsort(begin, kind="stable")
            begin, end = begin[by], end[by]
            inner = block.first[np.searchsorted(block.first, begin, side="right")]
        row = np.searchsorted(block.first, begin, side="right") - 1
        for r, b, e in zip(row.tolist(), (begin - block.first[row]).tolist(), (end - block.first[row]).tolist(), strict=True):
            out[r] += f"{',' * bool(out[r])}{b}:{e}"
    return pa.array(out, pa.string())


def without(block: Block, keep: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    data, n = block.data.copy(), len(block.data)
    kept = np.flatnonzero(keep)
    row = np.searchsorted(block.first, kept, side="right") - 1
    more = np.zeros(len(kept), dtype=bool)  # another kept word of the same text follows
    more[:-1] = row[1:] == row[:-1]
    flags = np.zeros(n + 2, dtype=np.int8)
    gap = block.end[kept[more]]
    data[gap] = 0x20
    flags[block.start[kept]] += 1
    end = block.end[kept].copy()
    end[more] += 1
    np.subtract.at(flags, end, 1)
    mask = np.cumsum(flags[:n], dtype=np.int8) > 0
    before = np.concatenate([[0], np.cumsum(mask)])
    offsets = before[block.at].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(block.at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[mask])]).cast(pa.string())


def deduplicated(docs: DataFrame, n: int = WINDOW, gram: int = GRAM, sketch_bits: int = 27) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed; see the module's text."""
    keyed = keys(docs)
    found = repeats(keyed, anchor_items(n, gram), bits=sketch_bits)
    return removed(docs, repeated_windows(keyed, n, gram, found), n)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "removed")
