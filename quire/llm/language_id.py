"""Language identification by a bidirectional gated recurrent network over bytes (operator 7).

The network is trained in numpy, on the driver, by backpropagation through time. It reads byte strips of a bounded
sample of labelled documents (SAMPLE_DOCS documents, SAMPLE_STRIPS strips of STRIP bytes each). Prediction reads every byte of
every text: texts are cut into sequences of SEQUENCE bytes, every position of which gets a probability for each
language, and a document's probabilities are the means over its positions.

Defined results: a null text, and one without a letter, is `und` with score 0, as is everything if no language could be
learned; ties go to the language first in code point order; rows with a null doc_id are neither learned from nor held
out; repeated rows get equal results; an empty table gives an empty result; other columns are neither read nor changed.
A letter is a character of which str.isalpha() holds; digits, fractions and raised figures are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import pieces, plainly_named, record, small_batches, text_bytes

SAMPLE_DOCS = 4000
SAMPLE_STRIPS = 8
STRIP = 32
SEQUENCE = 64
HIDDEN = 8
#: Sequences run through the network at a time.
LANES = 4096
FOLDS = 5
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    # the pattern also finds numbers such as fractions, which are no letters
    return bool(text) and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


@dataclass
class Direction:
    """Gates' inputs for each byte (3H x 256: reset, update, candidate) and recurrent weights (3H x H)."""

    table: np.ndarray
    weight: np.ndarray

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, H, lanes) for bytes x (steps, lanes); keep gets what backpropagation needs."""
        hidden, lanes = self.weight.shape[1], x.shape[1]
        out = np.empty((len(x), hidden, lanes), dtype=np.float32)
        h = np.zeros((hidden, lanes), dtype=np.float32)
        a, c = np.empty((3 * hidden, lanes), np.float32), np.empty((3 * hidden, lanes), np.float32)
        for t in range(len(x)):
            np.take(self.table, x[t], axis=1, out=a, mode="clip")
            np.matmul(self.weight, h, out=c)
            gate = a[: 2 * hidden] + c[: 2 * hidden]
            _soft(gate)
            gate *= 0.5
            gate += 0.5
            r, z = gate[:hidden], gate[hidden:]
            n = r * c[2 * hidden :]
            n += a[2 * hidden :]
            raw = n.copy() if keep is not None else None
            _soft(n)
            if keep is not None:
                keep.append((h, r, z, n, c[2 * hidden :].copy(), raw))
            h = h - n
            h *= z
            h += n
            out[t] = h
        return out

    def gradients(self, x: np.ndarray, keep: list, upstream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and weight, back through time, for upstream (steps, H, lanes)."""
        hidden, lanes = self.weight.shape[1], x.shape[1]
        d_weight, d_in = np.zeros_like(self.weight), np.empty((len(x), 3 * hidden, lanes), np.float32)
        d = np.zeros((hidden, lanes), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, r, z, n, c, raw = keep[t]
            d = d + upstream[t]
            d_n = d * (1 - z) * _slope(raw)
            # a gate is 0.5 + 0.5 s, s the soft sign, whose slope is (1 - |s|) squared
            d_r = d_n * c * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            d_z = d * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_c = np.concatenate([d_r, d_z, d_n * r])
            d_weight += d_c @ h.T
            d_in[t] = np.concatenate([d_r, d_z, d_n])
            d = d * z + self.weight.T @ d_c
        hot = np.zeros((x.size, 256), dtype=np.float32)
        hot[np.arange(x.size), x.ravel()] = 1
        return d_in.transpose(1, 0, 2).reshape(3 * hidden, -1) @ hot, d_weight


def _soft(a: np.ndarray) -> None:
    """The soft sign x / (1 + |x|), in place: a sigmoid shape without exponentials."""
    d = np.abs(a)
    d += 1
    a /= d


def _slope(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(raw)) ** 2


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language at every position: (L, steps, lanes) for bytes x (steps, lanes)."""
        f, b = self.ahead.states(x), self.back.states(x[::-1])[::-1]
        hidden = f.shape[1]
        out = np.empty((len(self.languages), *x.shape), dtype=np.float32)
        for t in range(len(x)):
            out[:, t] = _softmax(self.out[:, :hidden] @ f[t] + self.out[:, hidden:] @ b[t] + self.bias)
        return out

    def documents(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probability of each language over all bytes of each text (texts x L)."""
        size = np.diff(at)
        rows = -(-size // SEQUENCE)
        owner = np.repeat(np.arange(len(size)), rows)
        begin = at[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)) * SEQUENCE
        length = np.minimum(SEQUENCE, at[owner + 1] - begin)
        total = np.zeros((len(size), len(self.languages)))
        padded = np.concatenate([data, np.zeros(SEQUENCE, np.uint8)])
        for i in range(0, len(begin), LANES):
            b, n = begin[i : i + LANES], length[i : i + LANES]
            x = padded[b[None, :] + np.arange(SEQUENCE)[:, None]]
            real = np.arange(SEQUENCE)[:, None] < n[None, :]
            x[~real] = 0
            p = (self.positions(x) * real).sum(axis=1)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner[i : i + LANES], p[k], len(size))
        return total / np.maximum(size, 1)[:, None]


def _softmax(a: np.ndarray) -> np.ndarray:
    a -= a.max(axis=0)
    np.exp(a, out=a)
    a /= a.sum(axis=0)
    return a


def trained(strips: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 200, lanes: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted to strips (n x STRIP bytes) by Adam on the cross-entropy of all positions."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    net = Network(languages, *(Direction(normal(3 * HIDDEN, 256), normal(3 * HIDDEN, HIDDEN)) for _ in range(2)), normal(len(languages), 2 * HIDDEN), np.zeros((len(languages), 1), np.float32))
    params = [net.ahead.table, net.ahead.weight, net.back.table, net.back.weight, net.out, net.bias]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(len(languages), size=lanes)])
        x, y = np.ascontiguousarray(strips[pick].T), labels[pick]
        kept_f, kept_b = [], []
        f, b = net.ahead.states(x, kept_f), net.back.states(np.ascontiguousarray(x[::-1]), kept_b)
        both = np.concatenate([f, b[::-1]], axis=1)
        d = np.stack([_softmax(net.out @ s + net.bias) for s in both])
        d[:, y, np.arange(lanes)] -= 1
        d /= d.shape[0] * lanes
        d_both = np.einsum("lh,tlb->thb", net.out, d)
        grads = [*net.ahead.gradients(x, kept_f, d_both[:, :HIDDEN]), *net.back.gradients(np.ascontiguousarray(x[::-1]), kept_b, d_both[::-1, HIDDEN:])]
        grads += [np.einsum("tlb,thb->lh", d, both), d.sum(axis=(0, 2))[:, None]]
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def sampled(docs: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, lang, strips): of each language about most / languages documents of the learning folds, and one at least on average, drawn
    by a hash; of all languages together never more than twice `most`."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (fold() != 0))
    counts = usable.groupBy("lang").agg(F.count("*").alias("_n"))
    languages = counts.count()
    each = max(1, most // max(1, languages))
    share = F.least(F.lit(1.0), F.lit(float(each)) / F.col("_n"))
    drawn = usable.join(F.broadcast(counts) if languages <= most else counts, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, at = text_bytes(part.column("text"))
                out = []
                for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = data[b:e]
                    if len(own) < STRIP:
                        own = np.resize(own, STRIP)
                    starts = np.linspace(0, len(own) - STRIP, SAMPLE_STRIPS).astype(int)
                    out.append(b"".join(own[s : s + STRIP].tobytes() for s in starts))
                yield record(["doc_id", "lang", "strips"], [part.column("doc_id"), part.column("lang"), pa.array(out, pa.binary())])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = drawn.select("doc_id", "lang", "text").mapInArrow(strips, f"doc_id {kind}, lang string, strips binary")
    return rows.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(2 * most)


def learned(docs: DataFrame, most: int = SAMPLE_DOCS) -> Network | None:
    rows = sampled(docs, most).orderBy("lang", "doc_id", "strips").toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    strips = np.frombuffer(b"".join(rows["strips"]), dtype=np.uint8).reshape(-1, STRIP)
    labels = np.repeat(np.searchsorted(languages, rows["lang"]), SAMPLE_STRIPS)
    return trained(strips, labels, languages)


def predicted(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score under names; columns of these names that docs has are replaced."""
    small_batches(docs.sparkSession)
    new = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in names]
    rows, inner = plainly_named(docs, [f.name for f in kept])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column("text").to_pylist()
                letters = np.array([has_letter(t) for t in texts])
                best_of, scores = np.array([UNKNOWN] * len(texts), dtype=object), np.zeros(len(texts))
                if net and letters.any():
                    p = net.documents(*text_bytes(part.column("text")))
                    best = p.argmax(axis=1)
                    best_of[letters] = np.array(net.languages, dtype=object)[best[letters]]
                    scores[letters] = np.clip(p[np.arange(len(p)), best], 0, 1)[letters]
                yield record([*(f.name for f in kept), *names], [*(part.column(c) for c in inner), pa.array(best_of.tolist(), pa.string()), scores])

    return rows.mapInArrow(predict, T.StructType(kept + new))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predicted(docs.select("doc_id", "text"), learned(docs))
    return rows.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
