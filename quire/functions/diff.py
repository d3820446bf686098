"""Exact text-diff semantics, in Arrow-batched pandas functions over the standard difflib and zlib.

Every function keeps results of equal inputs within a batch, so texts that many reviewers send cost one diff.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from difflib import SequenceMatcher
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGES = "array<struct<start:int,end:int,original:string,replacement:string>>"
_WORD = re.compile(r"\S+")


def _once(f, *columns: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for key in zip(*columns, strict=True):
        if key not in seen:
            seen[key] = f(*key)
        out.append(seen[key])
    return pd.Series(out, dtype=object)


def ratio(a: str | None, b: str | None) -> float | None:
    """Word similarity with the matcher's default handling of popular words, 4 decimals."""
    if a is None or b is None:
        return None
    first, second = a.split(), b.split()
    return 1.0 if first == second else round(SequenceMatcher(None, first, second).ratio(), 4)


def _ends(a: list[str], b: list[str]) -> tuple[int, int]:
    """How many words a and b share at their beginning and, of the rest, at their end."""
    n, k, m = min(len(a), len(b)), 0, 0
    while k < n and a[k] == b[k]:
        k += 1
    while m < n - k and a[-m - 1] == b[-m - 1]:
        m += 1
    return k, m


def _opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """The matcher's steps but the equal ones. Where no word stands twice in a text, words shared at the ends can match nothing
    else, so only what lies between them is matched, if there is anything on both sides."""
    k = m = 0
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        k, m = _ends(a, b)
    x, y = a[k : len(a) - m], b[k : len(b) - m]
    if not x or not y:
        return [("delete" if x else "insert", k, len(a) - m, k, len(b) - m)] if x or y else []
    steps = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [(tag, i + k, j + k, p + k, q + k) for tag, i, j, p, q in steps if tag != "equal"]


def _cut(text: str, words: list[str], begin: int, end: int) -> str:
    """The words from begin to end as they stand in text, with the blanks between them."""
    if end - begin < 2:
        return words[begin] if begin < end else ""
    spans = [m.span() for m in _WORD.finditer(text)]
    return text[spans[begin][0] : spans[end - 1][1]]


def word_changes(base: str | None, suggested: str | None) -> list[dict] | None:
    """Changes that turn base's words into suggested's; replaced texts are verbatim, with the blanks inside them."""
    if base is None:
        return None
    new = suggested or ""
    a, b = base.split(), new.split()
    return [{"start": i, "end": j, "original": _cut(base, a, i, j), "replacement": _cut(new, b, k, m)} for _, i, j, k, m in _opcodes(a, b)]


def compatible(changes: list[dict], n: int) -> list[dict]:
    """Changes that can stand together in a text of n words, in text order: each ends before the next one begins, and where
    two overlap the one that begins later stays. Of changes at one place the one given first comes last."""
    kept, bound = deque(), n + 1
    for c in sorted(reversed(changes), key=itemgetter("start", "end"))[::-1]:
        inside = c["start"] == c["end"] or c["start"] < n
        if inside and c["end"] <= bound:
            kept.appendleft(c)
            bound = c["start"]
    return list(kept)


def with_changes(base: str, changes: list[dict]) -> str:
    """base with its compatible changes, put together once from left to right.

    What is replaced is the characters between two words; an insertion is parted from a neighbour by one blank."""
    words = [m.span() for m in _WORD.finditer(base)]
    parts, at, after_insert = [], 0, False

    def put(piece: str) -> None:
        nonlocal after_insert
        if piece:
            parts.append(f" {piece}" if after_insert and not piece[0].isspace() else piece)
            after_insert = False

    for c in compatible(changes, len(words)):
        insert = c["start"] == c["end"]
        begin = words[c["start"]][0] if c["start"] < len(words) else len(base)
        put(base[at:begin])
        if insert:
            part = begin and not base[begin - 1].isspace()
            put(" " * bool(part) + c["replacement"])
            after_insert = True
            at = begin
        else:
            put(c["replacement"])
            at = words[min(c["end"], len(words)) - 1][1]
    put(base[at:])
    return "".join(parts)


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words on one longest common subsequence; going back from the end, ties drop from a first.

    Words shared at the end are matched first on the way back; those at the beginning are set aside if none of them stands
    in what lies between, so that only this is compared word by word."""
    k, s = _ends(a, b)
    if not set(a[:k]).isdisjoint(a[k : len(a) - s] + b[k : len(b) - s]):
        k = 0
    found = _anchors(a[k : len(a) - s], b[k : len(b) - s])
    return [*((i, i) for i in range(k)), *((i + k, j + k) for i, j in found), *((len(a) - i, len(b) - i) for i in range(s, 0, -1))]


def _anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), dtype=np.int32)
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in side], dtype=np.int64) for side in (a, b))
    for i in range(n):
        diagonal = np.where(y == x[i], best[i, :-1] + 1, 0) if m else best[i, :-1]
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], diagonal))
    out, i, j = [], n, m
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i - 1, j] >= best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _score(common: int, total: int) -> int:
    """Percentage of words on the common subsequence, halves rounded up; two empty texts are 100."""
    return int(np.floor(200 * common / total + 0.5)) if total else 100


def alignment_score(a: str | None, b: str | None) -> int:
    x, y = _WORD.findall(a or ""), _WORD.findall(b or "")
    k, s = _ends(x, y)  # a longest common subsequence holds all words shared at the ends
    return _score(k + s + len(_anchors(x[k : len(x) - s], y[k : len(y) - s])), len(x) + len(y))


# The least score of texts that belong together, and the widest gap that a selection is projected to.
LEAST_SCORE = 15
GAP_WORDS = 6
GAP_FACTOR = 4


def projection(a: str | None, b: str | None, start: int, end: int) -> str | None:
    """What b has between the anchors around a's words start to end; null where the texts or the gap don't fit."""
    x, words = _WORD.findall(a or ""), [m.span() for m in _WORD.finditer(b or "")]
    pairs = anchors(x, [b[i:j] for i, j in words])
    if not words or _score(len(pairs), len(x) + len(words)) < LEAST_SCORE:
        return None
    own = [i for i, _ in pairs]
    theirs = [-1, *(j for _, j in pairs), len(words)]
    inside = words[theirs[bisect_left(own, start)] + 1 : theirs[bisect_left(own, end) + 1]]
    if len(inside) > max(GAP_WORDS, GAP_FACTOR * (end - start)):
        return None
    return b[inside[0][0] : inside[-1][1]] if inside else ""


def zlib_share(text: str | None) -> float | None:
    """Size of the text compressed by zlib at level 9, over its size."""
    raw = (text or "").encode()
    return len(zlib.compress(raw, 9)) / len(raw) if raw else None


def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return _once(ratio, a, b).astype("float64")


def _diff(base: pd.Series, suggested: pd.Series) -> pd.Series:
    return _once(word_changes, base, suggested)


def _apply(base: pd.Series, changes: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else with_changes(b, list(c) if c is not None else []) for b, c in zip(base, changes, strict=True)], dtype=object)


def _alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return _once(alignment_score, a, b).astype("int32")


def _projection(a: pd.Series, b: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    return _once(projection, a, b, start, end)


def _compressed(t: pd.Series) -> pd.Series:
    return _once(zlib_share, t).astype("float64")


# The functions are made where they are used, on the driver; executors import this module without a session.


def similarity(a: Column, b: Column) -> Column:
    return F.pandas_udf(_similarity, "double")(a, b)


def diff_changes(base: Column | str, suggested: Column | str) -> Column:
    # called nondeterministic so that no filter on the changes finds them once more
    return F.pandas_udf(_diff, CHANGES).asNondeterministic()(base, suggested)


def apply_changes(base: Column | str, changes: Column) -> Column:
    return F.pandas_udf(_apply, "string")(base, changes)


def alignment(a: Column, b: Column) -> Column:
    return F.pandas_udf(_alignment, "int")(a, b)


def project_selection(a: Column, b: Column, start: Column, end: Column) -> Column:
    return F.pandas_udf(_projection, "string")(a, b, start, end)


def compressed_share(t: Column) -> Column:
    return F.pandas_udf(_compressed, "double")(t)


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "mid").otherwise("low")
