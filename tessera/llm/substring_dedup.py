"""Substring de-duplication by seed and extend on winnowed word anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import repeats

WINDOW, GRAM = 20, 8


def extend(c: dict[str, np.ndarray], texts: list[bytes], s: repeats.Settings) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Extend the anchors both ways, word by word, and keep the maximal matches that reach the window length.

    Words are compared by their text: each different word of the bucket has a number. All anchors with the same words start
    as one group; a step to the left or right parts a group by the next word, so after o steps left and r steps right
    the anchors of a group match over all of o + gram + r words, without any pair being formed. Where that is a window,
    all but the group's earliest place are repeats; the steps that are repeats for one anchor make its maximal matches.
    """
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in t.split(b" ")] for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter((w for t in words for w in t), np.int64, int(lengths.sum()))
    left, right, room = c["left"].astype(np.int64), c["right"].astype(np.int64), s.window - s.gram
    anchor = np.cumsum(lengths) - lengths + left

    def part(groups: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.unique(groups * (int(by.max()) + 1) + by, return_inverse=True)[1] if len(by) else by

    start = word[anchor]
    for k in range(1, s.gram):
        start = part(start, word[anchor + k])

    def steps(reach: np.ndarray, next_word: Callable[[np.ndarray, int], np.ndarray]) -> list[np.ndarray]:
        out = [start]
        for k in range(1, int(reach.max(initial=0)) + 1):
            rows = np.flatnonzero(reach >= k)
            groups = np.full(len(start), -1)
            groups[rows] = part(out[-1][rows], next_word(rows, k))
            out.append(groups)
        return out

    lefts = steps(left, lambda rows, k: word[anchor[rows] - k])
    rights = steps(room - right, lambda rows, k: word[anchor[rows] + s.gram + k - 1])
    doc, at = c["doc"], c["at"].astype(np.int64)
    repeat = np.zeros((len(start), room + 3), bool)  # a column of False at both ends
    for o in range(room + 1):
        rows = np.flatnonzero((right <= o) & (o <= left))
        if not len(rows):
            continue
        group = part(lefts[o][rows], rights[room - o][rows])
        order = np.lexsort((at[rows], doc[rows], group))
        rows, group = rows[order], group[order]
        first = rows[np.searchsorted(group, group)]
        repeat[rows, o + 1] = (doc[rows] != doc[first]) | (at[rows] != at[first]) if s.within else doc[rows] > doc[first]
    edge = np.diff(repeat.view(np.int8), axis=1)
    row, opens = np.nonzero(edge == 1)  # runs of steps left, from `opens` to `closes` - 1
    closes = np.nonzero(edge == -1)[1]
    spans = {"doc": doc[row], "start": (at[row] - (closes - 1)).astype(np.uint32), "end": (at[row] - opens + s.window).astype(np.uint32)}
    return spans, np.zeros(0, np.int32)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("text_sha256", pa.string())])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = True, digests: bool = False) -> DataFrame:
    """Remove every word that a repeat of `window` or more words covers, but at its first place in (doc_id, start).

    docs: doc_id, text; other columns are ignored. Returns one row for each non-null doc_id: n_words, n_removed,
    kept_sha256 (of the words left, joined by a space) and, if `texts`, kept: the text itself where nothing went, else the
    words left, joined by a space. With `digests`, text_sha256 tells the texts of one doc_id apart (null: as empty). A null or empty text has no words and keeps
    the empty string; a document shorter than the window keeps all; an empty table gives an empty result. A repeated row is
    the same document again and gives the same row again; different texts of one doc_id share their spans.
    """
    s = repeats.Settings("word", window, gram, True, False)
    blobs, spans, _ = repeats.spans_of_repeats(docs, s, extend)

    def row(doc_id: int, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        words = text.split()
        kept, at = [], 0
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept += words[at:a]
            at = b
        kept += words[at:]
        whole = b" ".join(kept)
        return doc_id, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), (whole if len(kept) < len(words) else text).decode("utf-8", "replace") if texts else None, hashlib.sha256(text).hexdigest() if digests else None

    out = repeats.apply_spans(blobs, spans, row, SCHEMA, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, text_sha256 string")
    return out if digests else out.drop("text_sha256")
