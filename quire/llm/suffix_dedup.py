"""Passage dedup with sparse suffix arrays (operator 4).

Of all suffixes of all documents only those at content-selected places are retained: the leftmost of the smallest
GRAM-word grams in every REACH+GRAM-word stretch. Any passage of at least `least` words that repeats holds such a place
within its first REACH words in every copy, and so a retained suffix whose next `head` = least - REACH + 1 words are
in the passage. The retained suffixes are sorted over all documents, by the fingerprint of the head, then word by word by
the REACH - 1 words behind it and those before it outwards, then by document and place; words are compared by 64-bit hashes,
any fixed order of words being as good as another. Each suffix is compared with its neighbour in the sorted array: from equal
heads the match is extended word by word to the right and to the left, at most REACH - 1 words each way, further words being
covered from the passage's next retained suffixes. A match of `least` words or more marks its words in the later of the
two copies as repeated; these are cut out.

A head lies in REACH windows of `least` words. Copies that share one of them need not be neighbours where their words
differ on one side. So of suffixes with equal heads and surroundings the first stands for all, and what comparing these
with their neighbours leaves unmarked, in runs of three or more, is grouped by the fingerprint of the window's words; all
but the first of each group are marked too. A word is removed if and only if a window of `least` words over it also starts
earlier. Tasks hold ranges of the sorted array, so a hot head is spread over as many tasks as its suffixes need; a run
that reaches a range's edge may go on in the next one, and its representatives are all grouped. A count-min sketch of all
heads comes first; only suffixes whose head is estimated to occur twice or more are sorted at all.

Defined results: as in substring_dedup.py for nulls, repeated ids, long texts, empty tables and other columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import U64, Block, blocks, mix, record, sequence_hashes, signed
from quire.llm.sketch import Repeats, repeats
from quire.llm.substring_dedup import CHUNK_WINDOWS, ROWS, Chunk, anchors, document_order, keys, known_runs, later_windows, removed

LEAST = 50
REACH = 9
GRAM = 16


def retained(block: Block, words: np.ndarray, least: int, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of retained suffixes with a whole head, and their texts' rows."""
    head = least - reach + 1
    _, place, _ = anchors(words, block.first, reach + gram - 1, min(gram, head))
    place = np.unique(place)
    row = np.searchsorted(block.first, place, side="right") - 1
    whole = place + head <= block.first[row + 1]
    return place[whole], row[whole], head


def suffix_items(least: int, reach: int, gram: int):
    def items(block: Block) -> np.ndarray:
        words = block.word_hashes()
        place, _, head = retained(block, words, least, reach, gram)
        return sequence_hashes(words, head)[place] if len(place) else np.zeros(0, np.uint64)

    return items


def contexts(words: np.ndarray, first: np.ndarray, place: np.ndarray, row: np.ndarray, head: int, reach: int) -> pa.Array:
    """For each place the hashes of reach-1 words behind its head and as many to the left of it outwards, zeros beyond the text."""
    side = reach - 1
    at = np.concatenate([place[:, None] + head + np.arange(side), place[:, None] - 1 - np.arange(side)], axis=1)
    known = (at >= first[row][:, None]) & (at < first[row + 1][:, None])
    h = np.where(known, np.maximum(words[np.clip(at, 0, len(words) - 1)], U64(1)), U64(0))
    raw = np.ascontiguousarray(h).view(np.uint8).ravel()
    return pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(np.arange(len(place) + 1, dtype=np.int32) * 16 * side), pa.py_buffer(raw)])


def suffixes(keyed: DataFrame, found: Repeats, least: int, reach: int, gram: int) -> DataFrame:
    """(h1, h2, id, th, place, context) of the retained suffixes whose head is estimated as repeated."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches):
            words = block.word_hashes()
            place, row, head = retained(block, words, least, reach, gram)
            if not len(place):
                continue
            h1 = sequence_hashes(words, head)
            again = found.of(h1[place])
            place, row = place[again], row[again]
            if not len(place):
                continue
            h2 = sequence_hashes(block.word_hashes(1), head, 1)[place]
            ids, th = (part.column(c).to_numpy()[row] for c in ("id", "th"))
            yield record(["h1", "h2", "id", "th", "place", "context"], [signed(h1[place]), signed(h2), ids, th, (place - block.first[row]).astype(np.int32), contexts(words, block.first, place, row, head, reach)])

    return keyed.mapInArrow(retain, "h1 long, h2 long, id long, th long, place int, context binary")


#: Columns of a suffix beside its context.
OWN = ("h1", "h2", "id", "th", "place")


class Suffixes:
    """Rows of the sorted array: OWN's columns, words (behind the head, then before it) and, for each window around the head by
    its number of words before the head, whether a neighbour has settled that it starts earlier."""

    def __init__(self, columns: dict[str, np.ndarray], words: np.ndarray, settled: np.ndarray) -> None:
        self.columns, self.words, self.settled = columns, words, settled

    @classmethod
    def read(cls, batch: pa.RecordBatch, side: int) -> Suffixes:
        words = np.frombuffer(b"".join(batch.column("context").to_pylist()), dtype=U64).reshape(-1, 2 * side)
        return cls({c: batch.column(c).to_numpy() for c in OWN}, words, np.zeros((len(words), side + 1), dtype=bool))

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, at) -> Suffixes:
        return Suffixes({c: v[at] for c, v in self.columns.items()}, self.words[at], self.settled[at])

    def then(self, other: Suffixes) -> Suffixes:
        columns = {c: np.concatenate([v, other.columns[c]]) for c, v in self.columns.items()}
        return Suffixes(columns, np.concatenate([self.words, other.words]), np.concatenate([self.settled, other.settled]))

    def equal_heads(self) -> np.ndarray:
        """Whether each row but the first has its predecessor's head."""
        h1, h2 = self.columns["h1"], self.columns["h2"]
        return (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])


def reached(own: np.ndarray, other: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal words to the left and to the right of equal heads."""
    same = ((own == other) & (own != 0)).astype(np.int32)
    return np.cumprod(same[:, side:], axis=1).sum(axis=1), np.cumprod(same[:, :side], axis=1).sum(axis=1)


def chained(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of each row's first 0, 1, 2, ... words."""
    out = np.full((len(words), words.shape[1] + 1), seed, dtype=U64)
    for i in range(words.shape[1]):
        out[:, i + 1] = mix(out[:, i] * U64(0x9E3779B97F4A7C15) + words[:, i])
    return out


def marks(rows: Suffixes, left: np.ndarray, right: np.ndarray, side: int) -> Iterator[pa.RecordBatch]:
    """Rows' words, so many of them beside the head, as repeated where they make up a window."""
    long = left + right >= side
    if long.any():
        ids, th, place = (rows.columns[c][long] for c in ("id", "th", "place"))
        yield known_runs(ids, th, place - left[long], place - side + right[long])


def representatives(rows: Suffixes, side: int) -> tuple[Suffixes, list[pa.RecordBatch]]:
    """The first of rows with equal heads and surroundings, and the marks of all words around the others' heads."""
    new = np.ones(len(rows), dtype=bool)
    new[1:] = ~(rows.equal_heads() & (rows.words[1:] == rows.words[:-1]).all(axis=1))
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    # rows that repeat an id and its text are one document
    other = np.any([rows.columns[c] != rows.columns[c][head] for c in ("id", "th", "place")], axis=0)
    copies = rows[other]
    return rows[new], list(marks(copies, *reached(copies.words, copies.words, side), side))


def compare_neighbours(rows: Suffixes, since: int, side: int) -> Iterator[pa.RecordBatch]:
    """Marks, and notes in settled, the windows that neighbours with equal heads share, from row since on with its successor."""
    at = since + np.flatnonzero(rows.equal_heads()[since:])
    left, right = reached(rows.words[at], rows.words[at + 1], side)
    before = np.zeros(len(at), dtype=bool)  # the successor's copy starts earlier
    for c in ("place", "th", "id"):
        a, b = rows.columns[c][at], rows.columns[c][at + 1]
        before = np.where(a == b, before, b < a)
    a, b = rows.columns["th"][at] >= 0, rows.columns["th"][at + 1] >= 0
    before = np.where(a == b, before, a)  # documents without id come first
    later = at + ~before
    k = np.arange(side + 1)
    shared = (k <= left[:, None]) & (side - k <= right[:, None])
    # a row may be the later one of both of its pairs
    np.logical_or.at(rows.settled, later, shared)
    yield from marks(rows[later], left, right, side)


def add_windows(chunk: Chunk, rows: Suffixes, side: int) -> None:
    """Puts the windows around rows' heads that are not settled into chunk."""
    behind, before = rows.words[:, :side], rows.words[:, side:]
    prints = [(chained(before, seed), chained(behind, seed + 1)) for seed in (1, 3)]
    h1, h2, ids, th, place = (rows.columns[c] for c in OWN)
    for k in range(side + 1):  # k words to the left of the head, side - k behind it
        whole = (before[:, k - 1] != 0 if k else True) & (behind[:, side - k - 1] != 0 if k < side else True)
        at = np.flatnonzero(whole & ~rows.settled[:, k])
        if len(at):
            keys = (mix(mix(h[at].view(U64) ^ a[at, k]) ^ b[at, side - k]) + U64(k) for h, (a, b) in zip((h1, h2), prints, strict=True))
            chunk.add(*keys, ids[at], th[at], place[at] - np.int32(k))


def matches(rows: DataFrame, least: int, reach: int) -> DataFrame:
    """(id, th, run), a run being last << 32 | start: windows of `least` words around retained suffixes whose words also start earlier."""
    by = [F.col("h1"), F.col("h2"), F.col("context"), *document_order(), F.col("place")]
    side = reach - 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One range of the sorted array. The last two representatives of the open run are held until its next row is seen."""
        chunk, held = Chunk(), None
        earlier = 0  # representatives of the held ones' run that have been passed on
        at_edge = True  # the held ones' run began with the range, so it may have begun before
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            since = len(held) - 1 if held is not None else 0
            reps = held
            if batch is not None:
                rows = Suffixes.read(batch, side)
                reps, copies = representatives(held.then(rows) if held is not None else rows, side)
                yield from copies
                yield from compare_neighbours(reps, since, side)
            elif held is None:
                continue
            run = np.concatenate([[0], np.cumsum(~reps.equal_heads())])
            size = np.bincount(run)
            size[0] += earlier
            grouped = size > 2
            grouped[0] |= at_edge
            hold = 0
            if batch is None:
                grouped[-1] = True
            else:
                hold = min(2, int((run == run[-1]).sum()))
            done = len(reps) - hold
            add_windows(chunk, reps[np.flatnonzero(grouped[run[:done]])], side)
            if hold:
                earlier = int(size[-1]) - hold
                at_edge = at_edge and run[-1] == 0
                held = reps[done:]
            if chunk.size >= CHUNK_WINDOWS:
                yield from chunk.drain(least)
        if chunk.size:
            yield from chunk.drain(least)

    array = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return later_windows(array.mapInArrow(compare, ROWS))


def deduplicated(docs: DataFrame, least: int = LEAST, reach: int = REACH, gram: int = GRAM, sketch_bits: int = 27) -> DataFrame:
    """docs with n_words, n_removed, kept_text and removed (word ranges cut out); see the module's text."""
    keyed = keys(docs)
    found = repeats(keyed, suffix_items(least, reach, gram), bits=sketch_bits)
    return removed(docs, matches(suffixes(keyed, found, least, reach, gram), least, reach), least)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "removed")
