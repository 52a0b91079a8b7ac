"""Normalised Indel similarities in [0, 1]; 0 where either side is blank.

The kernel is a bit-parallel longest common subsequence that advances all
pairs of an Arrow batch at once: one 64-bit word per 64 characters of the
shorter string, one step per character of the longer one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the table of character masks of pairs that advance together, and characters of a side beyond which a pair goes alone.
TABLE_CELLS, LONGEST = 1 << 22, 1024


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    open_bits = full
    for c in a:
        hit = open_bits & masks.get(c, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(b) - open_bits.bit_count()


def _padded(texts: list[str], lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A row of symbol codes for each text; what lies beyond a text is never read."""
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = codes
    return out


def _together(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of the pairs a[i], b[i], where no b is longer than its a; the pairs come by falling length of a."""
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    symbols = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, codes = np.unique(symbols, return_inverse=True)
    x, y = _padded(a, n, codes[: n.sum()]), _padded(b, m, codes[n.sum() :])
    rows, words = np.arange(len(a)), int(m.max(initial=0) + 63) // 64
    masks = np.zeros((words, len(a), max(1, len(known))), np.uint64)
    for j in range(y.shape[1]):
        on = rows[j < m]
        masks[j // 64, on, y[on, j]] |= np.uint64(1 << j % 64)
    state = np.full((words, len(a)), np.uint64(2**64 - 1))
    active = np.searchsorted(-n, -np.arange(x.shape[1]), side="left")  # rows whose text reaches each step
    for i, k in enumerate(active.tolist()):
        carry = np.zeros(k, np.uint64)
        for w in range(words):
            mask, now = masks[w, rows[:k], x[:k, i]], state[w, :k]
            part = now + (now & mask)
            total = part + carry
            carry = ((part < now) | (total < part)).astype(np.uint64)
            state[w, :k] = total | (now & ~mask)
    out = np.zeros(len(a), np.int64)
    for w in range(words):
        bits = np.clip(m - 64 * w, 0, 64)
        full = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << (bits % 64).astype(np.uint64)) - np.uint64(1))
        out += bits - np.bitwise_count(state[w] & full)
    return out


def lcs_all(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of the pairs a[i], b[i]."""
    out = np.zeros(len(a), np.int64)
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    sizes = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2)
    alone = sizes[:, 0] > LONGEST
    for i in np.flatnonzero(alone).tolist():
        out[i] = lcs(*pairs[i])
    kind = (sizes[:, 1] + 63) // 64
    rest = np.flatnonzero(~alone & (sizes[:, 1] > 0))
    # pairs of one number of words, longest first, as many at a time as their table has room for
    rest = rest[np.lexsort((-sizes[rest, 0], kind[rest]))]
    symbols = max(1, len(set().union(*a, *b))) if len(rest) else 1
    start = 0
    while start < len(rest):
        words = int(kind[rest[start]])
        stop = min(start + max(1, TABLE_CELLS // (symbols * words)), int(np.searchsorted(kind[rest], words, side="right")))
        some = rest[start:stop].tolist()
        out[some] = _together([pairs[i][0] for i in some], [pairs[i][1] for i in some])
        start = stop
    return out


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    n, m = _lengths(a), _lengths(b)
    same = np.fromiter((x == y for x, y in zip(a, b, strict=True)), bool, len(a))
    out = np.where((n > 0) & (m > 0), same, 0.0)
    rest = np.flatnonzero(~same & (n > 0) & (m > 0))
    out[rest] = 2.0 * lcs_all([a[i] for i in rest], [b[i] for i in rest]) / (n[rest] + m[rest])
    return out


def _each(texts: list[str], fn: Callable):
    known: dict[str, object] = {}
    for t in texts:
        if t not in known:
            known[t] = fn(t)
    return [known[t] for t in texts]


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    in_order = lambda t: " ".join(sorted(t.split()))
    return ratios(_each(a, in_order), _each(b, in_order))


def token_set_ratios(a: list[str], b: list[str]) -> np.ndarray:
    tokens = lambda t: dict.fromkeys(sorted(t.split()))
    left, right, shared, blank = [], [], [], []
    for x, y in zip(_each(a, tokens), _each(b, tokens), strict=True):
        both = x.keys() & y.keys()
        blank.append(not x or not y)
        left.append(" ".join([t for t in x if t not in both] if both else x))
        right.append(" ".join([t for t in y if t not in both] if both else y))
        shared.append(sum(map(len, both)) + len(both) - 1 if both else 0)
    s, n, m = np.array(shared, np.int64), _lengths(left), _lengths(right)
    gap = (s > 0).astype(np.int64)
    p, q = s + gap + n, s + gap + m
    over = lambda u, v: np.divide(2.0 * u, v, out=np.zeros(len(s)), where=v > 0)
    out = over(s + gap + lcs_all(left, right), p + q)
    out = np.where(s > 0, np.maximum(out, np.maximum(over(s, s + p), over(s, s + q))), out)
    out[(s > 0) & ((n == 0) | (m == 0))] = 1.0
    out[np.array(blank, bool)] = 0.0
    return out


KERNELS = {"ratio": ratios, "token_sort": token_sort_ratios, "token_set": token_set_ratios}


def similarities(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """One struct of several similarities, a pass of Arrow batches for all of them.

    ``wanted`` names each by its kernel and its two texts; null counts as blank.
    """
    columns: list[Column] = []
    place: dict[str, int] = {}

    def at(col: Column) -> int:
        if str(col) not in place:
            place[str(col)] = len(columns)
            columns.append(col)
        return place[str(col)]

    plan = [(name, kernel, at(a), at(b)) for name, (kernel, a, b) in wanted.items()]

    @F.arrow_udf("struct<" + ", ".join(f"{name}: double" for name, *_ in plan) + ">")
    def score(*texts: pa.Array) -> pa.Array:
        held = [t.fill_null("").to_pylist() for t in texts]
        return pa.StructArray.from_arrays([pa.array(KERNELS[kernel](held[i], held[j])) for _, kernel, i, j in plan], names=[name for name, *_ in plan])

    return score(*columns)
