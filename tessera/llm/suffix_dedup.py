"""Suffix-array de-duplication by the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common, repeats

WINDOW, GRAM = 50, 12


def enhanced_suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[starts[i]:ends[i]] and the length of each one's common prefix with the one before.

    Suffixes are read as big-endian words of eight bytes, cut off by zero beyond their end; ties keep input order.
    """
    n, length = len(starts), ends - starts
    width = int(length.max()) if n else 0
    padded = np.r_[text, np.zeros(width + 8, np.uint8)]
    columns = []
    for at in range(0, width, 8):
        word = np.zeros(n, np.uint64)
        for k in range(8):
            byte = np.where(at + k < length, padded[starts + at + k], 0).astype(np.uint64)
            word = (word << np.uint64(8)) | byte
        columns.append(word)
    order = np.lexsort(columns[::-1]) if columns else np.arange(n)
    lcp = np.zeros(n, np.int64)
    open_, total = np.ones(max(n - 1, 0), bool), np.zeros(max(n - 1, 0), np.int64)
    for word in columns:
        word = word[order]
        differ = word[1:] ^ word[:-1]
        same = np.zeros(n - 1, np.int64)
        left = differ.copy()
        for _ in range(8):  # leading bytes that agree
            same += left >> np.uint64(56) == 0 if _ == 0 else (same == _) & (left >> np.uint64(56) == 0)
            left <<= np.uint64(8)
        total += np.where(open_, same, 0)
        open_ &= same == 8
    if n > 1:
        lcp[1:] = np.minimum(total, np.minimum(length[order][1:], length[order][:-1]))
    return order, lcp


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the common-prefix tree of at least `least`, found by a stack scan.

    before: what stands left of each suffix in suffix order, -1 where that is unknown. An interval is left-diverse, and
    so a maximal repeat, if its suffixes have two different bytes before them or an unknown one. The whole interval is
    given: all occurrences, not only neighbours. Inner intervals come before those that hold them.
    """
    n = len(lcp)
    lcp, before = lcp.tolist(), before.tolist()
    stack: list[list[int]] = []  # length, first, the byte before all so far (-2: diverse)
    join = lambda a, b: a if a == b and a != -1 else -2
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        if h < least and not stack:
            continue
        first, side = i - 1, -2 if before[i - 1] == -1 else before[i - 1]
        while stack and stack[-1][0] > h:
            length, first, inner = stack.pop()
            inner = join(inner, side)
            if inner == -2:
                yield length, first, i - 1
            side = inner
        if stack and stack[-1][0] == h:
            stack[-1][2] = join(stack[-1][2], side)
        elif h >= least:
            stack.append([h, first, side])


def intervals(c: dict[str, np.ndarray], texts: list[bytes], s: repeats.Settings) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Spans of the repeats among the contexts of one bucket: all occurrences but those in the smallest document.

    A context that has copies enters the array twice, so that a leaf of the tree stands for it and its whole list of
    places; the second value is the classes of which such a leaf was found. A context that shares nothing but with its
    copies (lone) enters by its longest suffix only.
    """
    count = np.where(c["lone"], 1, c["left"].astype(np.int64) - c["right"] + 1)
    text = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    lo = np.r_[0, np.cumsum(lengths)[:-1]]
    copied = np.flatnonzero(c["copied"])
    seed = np.r_[np.repeat(np.arange(len(texts)), count), copied]
    step = np.r_[common.ragged(np.zeros(len(texts), np.int64), count), np.zeros(len(copied), np.int64)]
    copy = np.arange(len(seed)) >= len(seed) - len(copied)
    order, lcp = enhanced_suffix_array(text, lo[seed] + step, (lo + lengths)[seed])
    near = lcp >= s.window
    alive = near | np.r_[near[1:], False]  # suffixes that share a window with a neighbour
    order, lcp = order[alive], np.where(near, lcp, 0)[alive]
    seed, step, copy = seed[order], step[order], copy[order]
    before = np.where(step > 0, text[np.maximum(lo[seed] + step - 1, 0)].astype(np.int64), np.int64(-1))
    doc = c["doc"][seed]
    place = c["at"][seed].astype(np.int64) - c["left"][seed] + step
    found = [(k, a, b + 1) for k, a, b in maximal_repeats(lcp, before, s.window)]
    if not found:
        return {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.uint32), "end": np.zeros(0, np.uint32)}, np.zeros(0, np.int32)
    length, a, b = np.array(found, np.int64).T
    rows, group = common.ragged(a, b - a), np.repeat(np.arange(len(a)), b - a)
    least = np.minimum.reduceat(doc[rows], np.r_[0, np.cumsum(b - a)[:-1]])
    whole = np.unique(c["class"][seed[rows[copy[rows] & (length[group] == lengths[seed[rows]])]]])
    later = (doc[rows] > least[group]) & ~copy[rows]
    rows, group = rows[later], group[later]
    return {"doc": doc[rows], "start": place[rows].astype(np.uint32), "end": (place[rows] + length[group]).astype(np.uint32)}, whole


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte that a string of `window` or more bytes covers which also starts in a smaller doc_id.

    docs: doc_id, text; other columns are ignored. Returns one row for each non-null doc_id: n_bytes, n_removed,
    n_spans, kept_sha256 of the bytes left, and the removed runs as starts and ends (bytes). Null and empty texts have
    no bytes; a text shorter than the window loses nothing; repeats inside one document alone stay; an empty table
    gives an empty result. Of equal documents the one with the smallest doc_id stays whole.
    A repeated row gives the same row again; different texts of one doc_id share their spans, as far as each text goes.
    """
    s = repeats.Settings("byte", window, gram, False, True)
    blobs, spans, _ = repeats.spans_of_repeats(docs, s, intervals)

    def row(doc_id: int, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        kept, at = hashlib.sha256(), 0
        ends = np.minimum(ends, len(text))  # of a longer text with the same doc_id
        starts, ends = starts[starts < ends], ends[starts < ends]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        return doc_id, len(text), int((ends - starts).sum()), len(starts), kept.hexdigest(), starts.tolist(), ends.tolist()

    return repeats.apply_spans(blobs, spans, row, SCHEMA, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
