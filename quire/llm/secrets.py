"""Secret scans (operator 6): three fixed patterns and sliding-window entropy of candidate strings.

A candidate is a maximal run of one character class (hexadecimal; base-64 and its URL form) that isn't on the
allow-list. Every window of it has its Shannon entropy computed from running counts, one character out and one in;
windows at or over the class's threshold join to spans. Spans count code points of the whole text, end exclusive.

Defined results: a null text is an empty one and has no span; texts of any length are read whole; repeated rows give
repeated rows; an empty table gives an empty result; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import pieces, plainly_named, record, small_batches

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ASSIGN_LEAST = 6
#: Runs of at least so many characters are the same as all runs with the shorter ones dropped.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
BASE = KINDS[:3]

#: A word with capitals: camel case, or capitals alone. No part of it or of the patterns below can match in two ways, and
#: what a part has taken it never gives back, so a run of any length is tested in one pass.
_CASED = rb"(?>[a-z]++(?:[A-Z][a-z]{2,}+)*+|(?:[A-Z][a-z]{2,}+)++|[A-Z]++)"
#: Patterns of strings whose look is random but that are no secrets. Whole ones stop the run that they match in full; the
#: others stop windows that lie over what they find, and leave the rest of the run to be judged.
ALLOWED = (
    (rb"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", True),  # UUIDs
    (rb"[0-9/_=+-]++", True),  # numbers and dates
    (rb"[/_=+-]*+(?:" + _CASED + rb"(?:[/_=+-]++" + _CASED + rb")*+[/_=+-]*+)?", True),  # words, camel case too, and paths or names made of them
    (rb"(?i)example|sample|placeholder|changeme|x{6,}|0123456789|abcdefgh", False),
)


@dataclass(frozen=True)
class CharClass:
    kind: str
    run: re.Pattern[bytes]
    window: int
    threshold: float


#: Character classes with window length and least entropy in bits.
CLASSES = (
    CharClass("entropy_hex", re.compile(rb"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{24,}(?![A-Za-z0-9+/_=-])"), 24, 3.0),
    CharClass("entropy_base64", re.compile(rb"[A-Za-z0-9+/_=-]{24,}"), 24, 3.8),
)


#: Windows judged at a time.
STEP = 1 << 14


def low_windows(data: np.ndarray, window: int, most: float) -> np.ndarray:
    """For every window of data whether the sum of c log2 c over its characters' counts c is at most `most`.

    Counts come from running counts of each character, so a window's differ from the one before by one in and one out."""
    part = np.array([0.0] + [c * math.log2(c) for c in range(1, window + 1)])
    names, code = np.unique(data, return_inverse=True)
    out = np.zeros(max(0, len(data) - window + 1), dtype=bool)
    for begin in range(0, len(out), STEP):
        end = min(begin + STEP, len(out))
        running = np.zeros((len(names), end - begin + window), dtype=np.int32)
        here = code[begin : end + window - 1]
        running[here, np.arange(1, len(here) + 1)] = 1
        np.cumsum(running, axis=1, out=running)
        out[begin:end] = part[running[:, window:] - running[:, :-window]].sum(axis=0) <= most
    return out


def entropy_spans(runs: list[bytes], window: int, threshold: float, allowed: list[list[tuple[int, int]]] | None = None) -> list[tuple[int, int, int]]:
    """(run, start, end) of the joined windows of runs whose entropy is at least threshold and that share no character with an
    allowed place of their run; all runs at once."""
    if not runs:
        return []
    data = np.frombuffer(b"".join(runs), np.uint8)
    first = np.cumsum([0] + [len(r) for r in runs])
    good = low_windows(data, window, window * (math.log2(window) - threshold) + 1e-9)
    inner = np.ones(len(data), dtype=bool)  # a window that starts here ends in its run
    for e in first[1:].tolist():
        inner[max(0, e - window + 1) : e] = False
    good &= inner[: len(good)]
    quiet = np.zeros(len(data) + 1, dtype=np.int64)
    for begin, places in zip(first.tolist(), allowed or (), strict=False):
        for b, e in places:
            quiet[begin + b + 1 : begin + e + 1] = 1
    quiet = np.cumsum(quiet)
    good &= (quiet[window:] == quiet[: len(quiet) - window])[: len(good)]
    start = np.flatnonzero(good)
    if not len(start):
        return []
    run = np.searchsorted(first, start, side="right") - 1
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] - start[:-1] > window) | (run[1:] != run[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1
    base = first[run[head]]
    return list(zip(run[head].tolist(), (start[head] - base).tolist(), (start[last] + window - base).tolist(), strict=True))


def scan(data: bytes, allowed: list[tuple[re.Pattern[bytes], bool]], classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes; data may be several texts parted by newlines, which no span crosses."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(data)]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(data)]
    base = sorted(x[1:] for x in found)
    at = np.array([b for b, _ in base], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in base], dtype=np.int64)) if base else at
    for c in classes:
        judged = [m for m in c.run.finditer(data) if m.end() - m.start() >= c.window and not any(whole and a.fullmatch(m.group()) for a, whole in allowed)]
        quiet = [[x.span() for a, whole in allowed if not whole for x in a.finditer(m.group())] for m in judged]
        for i, b, e in entropy_spans([m.group() for m in judged], c.window, c.threshold, quiet):
            b, e = judged[i].start() + b, judged[i].start() + e
            before = int(np.searchsorted(at, b, side="right")) - 1
            if before < 0 or reach[before] < e:  # else a base span holds it already
                found.append((KINDS.index(c.kind), b, e))
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def scanned(docs: DataFrame, allow: tuple[tuple[bytes, bool], ...] = ALLOWED, redact: str | None = None, prefix: str = "") -> DataFrame:
    """docs' rows with n_assign, n_access, n_hex, base_sha256, spans, named so behind prefix; with redact, text has each span replaced by it.

    Columns of these names that docs has are replaced.
    """
    small_batches(docs.sparkSession)
    new = [(prefix + n, t) for n, t in (("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()))]
    kept = [f for f in docs.schema.fields if f.name not in dict(new)]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in new])
    rows, inner = plainly_named(docs, [f.name for f in kept])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = [(re.compile(a), whole) for a, whole in allow]
        for batch in batches:
            for part in pieces(batch):
                yield one(part, allowed)

    def one(part: pa.RecordBatch, allowed: list[tuple[re.Pattern[bytes], bool]]) -> pa.RecordBatch:
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        data = b"\n".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts, spans, bases = np.zeros((3, len(texts)), dtype=np.int64), [[] for _ in texts], [[] for _ in texts]
        cuts: dict[int, list[tuple[int, int]]] = {}
        points = None
        for kind, b, e in scan(data, allowed):
            if points is None:  # code points before each byte
                points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            i = int(np.searchsorted(ends, b, side="right"))
            begin = int(ends[i]) - len(texts[i]) - 1
            name = f"{KINDS[kind]}:{points[b] - points[begin]}:{points[e] - points[begin]}"
            spans[i].append(name)
            if kind < len(BASE):
                counts[kind, i] += 1
                bases[i].append(name)
            cuts.setdefault(i, []).append((b - begin, e - begin))
        out = {f.name: part.column(c) for f, c in zip(kept, inner, strict=True)}
        if redact is not None and cuts:
            text = part.column("text").to_pylist()
            for i, own in cuts.items():
                text[i] = blanked(texts[i], own, redact.encode()).decode()
            out["text"] = pa.array(text, pa.string())
        digests = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in bases])
        out |= dict(zip((n for n, _ in new), (*counts, digests, pa.array([",".join(x) for x in spans])), strict=True))
        return record(list(out), list(out.values()))

    return rows.mapInArrow(work, schema)


def blanked(text: bytes, cuts: list[tuple[int, int]], by: bytes) -> bytes:
    """text with every cut (sorted by start), or cuts that overlap together, replaced."""
    out, at = [], 0
    for b, e in cuts:
        if b >= at:
            out += [text[at:b], by]
        at = max(at, e)
    return b"".join([*out, text[at:]])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs).drop("text").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
