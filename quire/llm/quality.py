"""Quality rules: gradient-boosted trees over document statistics (operator 9).

The statistics of every whole text are computed over byte arrays, a block of texts at a time. The trees are grown in
numpy on a bounded sample of labelled documents (SAMPLE_ROWS), by histograms of binned features, with monotonic
constraints on chosen features: a split against a constraint is refused, and each side's values stay within the
midpoint of the split. The ensemble is flattened to node arrays and scores batches level by level, without branches.

Defined results: a null text has no words and fails the base rule; labels that are null are not learned from; with no
usable labels, or only one kind, every document that passes the base rule is kept; repeated rows give repeated rows; an
empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import U64, Block, blocks, inside, mix, record, sequence_hashes, stored

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
#: Labelled documents that the trees are fitted to, at most about.
SAMPLE_ROWS = 20_000
#: Documents whose probability of good quality is below this are dropped.
LEAST = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_ends", "n_long_words", "n_distinct_words")
#: Features with the sign that their effect on quality may have; 0 is free.
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("line_words", 0), ("upper", -1), ("letters", 0), ("digits", 0), ("marks", 0), ("ends", 0), ("long_words", 0), ("distinct", 0))

_UPPER, _LETTER, _DIGIT, _MARK, _END = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC0:] = True  # a lead byte stands for a letter
_DIGIT[0x30:0x3A] = True
_MARK[list(b"!?")] = True
_END[list(b".!?")] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def _repeated(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item, whether its group has its hash twice or more."""
    by = np.lexsort((h, group))
    g, k = group[by], h[by]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(h), dtype=bool)
    out[by[1:][same]] = out[by[:-1][same]] = True
    return out


def statistics(block: Block) -> dict[str, np.ndarray]:
    data, first, n = block.data, block.first, len(block.first) - 1
    words = block.word_hashes()
    row = np.repeat(np.arange(n), block.n_words)
    heads = np.concatenate([[0], np.cumsum(_HEAD[data])])
    chars = heads[block.end] - heads[block.start]
    out = {"n_words": block.n_words, "word_chars": np.bincount(row, chars, n).astype(np.int64)}
    out["n_symbols"] = _per_text(SYMBOLS[data], block.at)
    # lines: the words and blanks between two line feeds, equal byte for byte
    inner = np.zeros(len(data) + 1, dtype=bool)
    inner[block.at] = True
    inner[np.flatnonzero(data == 0x0A) + 1] = True
    begin = np.flatnonzero(inner[: len(data)])
    end = np.append(begin[1:], len(data))
    end = end - ((end > begin) & (data[end - 1] == 0x0A)) if len(begin) else end
    filled = np.searchsorted(block.start, end) > np.searchsorted(block.start, begin)
    begin, end = begin[filled], end[filled]
    whole = _span_hashes(data, begin, end)
    line_row = np.searchsorted(block.at, begin, side="right") - 1
    by = np.lexsort((begin, whole, line_row))
    again = np.zeros(len(begin), dtype=bool)
    again[by[1:]] = (line_row[by[1:]] == line_row[by[:-1]]) & (whole[by[1:]] == whole[by[:-1]])
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    ok = np.flatnonzero(inside(first, WINDOW))
    grams = sequence_hashes(words, WINDOW)
    covered = np.zeros(len(words) + 1, dtype=np.int32)
    if len(ok):
        starts = ok[_repeated(row[ok], grams[ok])]
        covered[starts] += 1
        np.subtract.at(covered, starts + WINDOW, 1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=n)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    for name, table in (("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_ends", _END)):
        out[name] = _per_text(table[data], block.at)
    out["n_long_words"] = np.bincount(row[chars > 15], minlength=n)
    by = np.lexsort((words, row))
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[by[1:]] != words[by[:-1]]) | (row[by[1:]] != row[by[:-1]])
    out["n_distinct_words"] = np.bincount(row[by][new], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def _span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range and its length."""
    from quire.llm.common import _BYTE

    up, down = _BYTE[0].upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] ^ (end - begin).astype(U64) * U64(0x9E3779B97F4A7C15)) if len(begin) else np.zeros(0, U64)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches):
            yield record(["doc_id", *COUNTS], [part.column("doc_id"), *statistics(block).values()])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        np.log1p(words / lines), c["n_upper"] / chars, c["n_letters"] / chars, c["n_digits"] / chars, c["n_marks"] / words,
        c["n_ends"] / words, c["n_long_words"] / words, c["n_distinct_words"] / words,
    ])


@dataclass
class Trees:
    """Complete binary trees as node arrays: tree t's node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes); -1: always left
    cut: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[tree, node]
            right = (f >= 0) & (x[rows, np.maximum(f, 0)] > self.cut[tree, node])
            node = 2 * node + 1 + right
        return self.base + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-self.margin(x[i : i + 8192]))) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0)


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Trees:
    """Trees boosted on the logistic loss; each feature's effect follows its sign in signs."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.full((trees, inner), -1), np.zeros((trees, inner)), np.zeros((trees, leaves)), base, depth)
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        bound = {0: (-np.inf, np.inf)}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            low, high = bound[i]
            best = _best_split(binned[rows], g[rows], h[rows], cuts, signs, ridge, least, low, high) if len(rows) >= 2 * least else None
            if best is None:
                bound[2 * i + 1] = bound[2 * i + 2] = (low, high)
                node[rows] = 2 * i + 1
                continue
            j, b, left, right = best
            out.feature[t, i], out.cut[t, i] = j, cuts[j][b]
            middle = (left + right) / 2
            bound[2 * i + 1] = (low, min(high, middle)) if signs[j] > 0 else (max(low, middle), high) if signs[j] < 0 else (low, high)
            bound[2 * i + 2] = (max(low, middle), high) if signs[j] > 0 else (low, min(high, middle)) if signs[j] < 0 else (low, high)
            node[rows] = 2 * i + 1 + (binned[rows, j] > b)
        for leaf in range(leaves):
            rows = node == inner + leaf
            low, high = bound[inner + leaf]
            if rows.any():
                out.value[t, leaf] = rate * np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high)
            margin[rows] += out.value[t, leaf]
    return out


def _best_split(binned, g, h, cuts, signs, ridge, least, low, high):
    total_g, total_h = g.sum(), h.sum()
    best, found = 1e-6, None
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        size = len(c) + 1
        gl, hl, nl = (np.cumsum(np.bincount(binned[:, j], w, size))[:-1] for w in (g, h, np.ones(len(g))))
        left, right = np.clip(-gl / (hl + ridge), low, high), np.clip(-(total_g - gl) / (total_h - hl + ridge), low, high)
        gain = -(gl * left + 0.5 * (hl + ridge) * left**2) - ((total_g - gl) * right + 0.5 * (total_h - hl + ridge) * right**2)
        whole = np.clip(-total_g / (total_h + ridge), low, high)
        gain += total_g * whole + 0.5 * (total_h + ridge) * whole**2
        ok = (nl >= least) & (len(g) - nl >= least) & ((right - left) * signs[j] >= 0)
        gain = np.where(ok, gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best:
            best, found = gain[b], (j, b, float(left[b]), float(right[b]))
    return found


def learned(stats: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted to labelled rows of stats, about `most` of them and never more than twice as many, drawn by a hash of the id.
    Of rows that repeat an id the least by COUNTS counts; labels of one id that differ count as the smallest."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    each = stats.join(usable, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", "quality", "c.*")
    rows = each.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(2 * most).toPandas().sort_values(["doc_id", *COUNTS], kind="stable")
    y = (rows["quality"].to_numpy(dtype=np.float64) > 0).astype(np.float64) if len(rows) else np.zeros(0)
    if len(np.unique(y)) < 2:
        return None
    return grow(features({c: rows[c].to_numpy() for c in COUNTS}), y, [s for _, s in FEATURES])


def judged(docs: DataFrame, labels: DataFrame, least: float = LEAST, sample: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of every row of docs."""
    stats = stored(measured(docs))
    trees = learned(stats, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy() for c in COUNTS}
            failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
            p = trees.score(features(counts)) if trees else np.ones(batch.num_rows)
            yield record([*batch.schema.names, "base_failed", "score", "kept"], [*batch.columns, failed, p, ~failed & (p >= least)])

    new = [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return stats.mapInArrow(score, T.StructType(stats.schema.fields + new))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
