"""Packing documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Tokens of a sequence, width of a length class, id that ends every document.
LENGTH, GRID, END = 2048, 4, 1
#: Stop when the plan is proven to be within this share of the least possible number of sequences.
GAP = 1e-3
#: Bytes of words and ids that a worker remembers; the memory is emptied before the next texts when full, which changes no result.
REMEMBERED = 150_000_000
#: Characters of the texts that are encoded together; a longer text is encoded alone.
TOGETHER = 8_000_000
#: Pieces for each bucket of a length class's ranking.
BUCKET_ROWS = 20_000
#: Python's white space holds four separators more than the tokenizer's; texts with them are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: ASCII marks: neither letters nor digits nor white space.
MARKS = string.punctuation
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


class WordEncoder:
    """Ids of a text by the tokenizers library, asked once for each word between white space.

    The vocabulary's rules (lower case, white space dropped, words by pattern) never look across white space, so the
    ids of a text are those of its words one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory: dict[str, bytes] = {}
        self.remembered, self.most = 0, REMEMBERED
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ask(self, words: list[str]) -> None:
        held = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        self.memory.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, held, strict=True))

    def ask_letters(self, words: list[str], together: int = 256) -> None:
        """Words of letters only: each is one word of the vocabulary's rules, so its ids end with a word end's id."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(group):
                self.ask(group)
                continue
            data = ids.tobytes()
            self.memory.update(zip(group, map(data.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def learn(self, missing: list[str]) -> None:
        """Remembers the ids of these words."""
        letters, others, parts = set(), set(), []
        for w in missing:
            if all_letters(w):
                letters.add(w)
            elif (head := w.rstrip(MARKS)) != w and head and all_letters(head):
                tail = w[len(head) :]  # no rule of the tokenizer joins letters and the marks behind them
                parts.append((w, head, tail))
                letters.add(head)
                others.add(tail)
            else:
                others.add(w)
        memory = self.memory
        if letters := list(letters.difference(memory)):
            self.ask_letters(letters)
        if others := list(others.difference(memory)):
            self.ask(others)
        for w, head, tail in parts:
            memory[w] = memory[head] + memory[tail]
        self.remembered += sum(250 + 2 * len(w) for w in missing)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Only the distinct words of all the texts are looked up; numpy lays their ids out."""
        odd = [bool(ODD_SPACE.search(t)) for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if self.remembered > self.most:
            self.memory.clear()
            self.remembered = 0
        self.learn([w for w in words if w not in self.memory])
        held = [self.memory[w] for w in words]
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // 4
        at = coded.indices.to_numpy()
        ids = np.frombuffer(b"".join(held), "<u4")[common.ragged((np.cumsum(lengths) - lengths)[at], lengths[at])]
        edges = np.r_[0, np.cumsum(lengths[at])][split.offsets.to_numpy()].tolist()
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if o else ids[s:e] for t, o, s, e in zip(texts, odd, edges, edges[1:], strict=False)]


def all_letters(word: str) -> bool:
    """Letters only, also in lower case, where a letter may become one with a mark."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


_loaded: dict[str, WordEncoder] = {}
common.caches.append(_loaded.clear)


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def cut(docs: DataFrame, path: str, length: int, tokens: bool, together: int = TOGETHER, remembered: int = REMEMBERED) -> DataFrame:
    """PIECE rows: every document's ids and END in full sequences, and what is left as one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        words.most = remembered
        for batch in common.slices(batches):
            rows: list[tuple] = []
            runs = common.chunks(batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], together)
            for doc_id, ids in (pair for some, texts in runs for pair in zip(some, words.encode_batch(texts), strict=True)):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32) if tokens else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        if remembered < REMEMBERED:  # short of memory: it goes back after each task, which costs time
            common.trim()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, PIECE)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most, by dynamic programming over the capacity."""
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        fit = np.searchsorted(sizes, w, "right")
        value[w] = value[w - 1]
        if fit:
            gains = value[w - sizes[:fit]] + worth[:fit]
            k = int(gains.argmax())
            if gains[k] > value[w] + 1e-12:
                value[w], taken[w] = gains[k], k
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            pattern[taken[w]] += 1
            w -= sizes[taken[w]]
    return float(value[capacity]), pattern


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern that takes of the largest sizes first what there is (a part of one counts as one) and what fits."""
    pattern, room, i = np.zeros(len(sizes)), capacity, len(sizes)
    while True:
        able = np.flatnonzero((left[:i] > 0) & (sizes[:i] <= room))
        if not len(able):
            return pattern
        i = int(able[-1])
        pattern[i] = min(room // sizes[i], np.ceil(left[i]))
        room -= int(pattern[i] * sizes[i])


def enter(inverse: np.ndarray, column: int, direction: np.ndarray) -> None:
    """The inverse of the basis after another pattern took the place of a column; direction: the old inverse times the pattern."""
    row = inverse[column] / direction[column]
    some = np.flatnonzero(direction)
    inverse[some] -= np.outer(direction[some], row)
    inverse[column] = row


def first_fit_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis of first-fit decreasing patterns, its inverse, and how often each pattern is used, in parts of one.

    Every pattern is used until one of its sizes is served, and is that size's column. It holds no size that was served
    before, so the columns by time are triangular; other sizes served at once get a column of their own, unused.
    """
    fill = (capacity // sizes).astype(np.float64)
    basis, inverse, x, left = np.diag(fill), np.diag(1 / fill), np.zeros(len(sizes)), demand.astype(np.float64).copy()
    while left.any():
        pattern = first_fit(sizes, left, capacity)
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        served = int(ratio.argmin())
        enter(inverse, served, pattern / fill)  # its sizes have columns of their own still, so this is the direction
        basis[:, served], x[served] = pattern, ratio[served]
        left = np.maximum(left - x[served] * pattern, 0)
        left[left < 1e-9 * demand] = 0
        left[served] = 0
    return basis, inverse, x


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each size) and how often each is used, together exactly the demand.

    The linear program over all patterns is solved by the revised simplex method with generated columns, from a basis of
    first-fit decreasing patterns: the prices of the present basis make a knapsack problem whose best pattern enters. It
    ends when the least number that is known to be needed (objective / best worth at any step, or all sizes by the
    capacity) proves the gap, or after so many rounds; the plan is exact in any case. Uses are rounded down; what is then left, less than one pattern of each of the basis, is
    packed first-fit decreasing.
    """
    m = len(sizes)
    if not m:
        return []
    basis, inverse, x = first_fit_basis(sizes, demand, capacity)
    least = float(demand @ sizes) / capacity
    for _ in range(rounds):
        if x.sum() <= least * (1 + gap):
            break
        prices = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, np.maximum(prices, 0), capacity)
        least = max(least, x.sum() / worth)
        direction = inverse @ column
        rising = direction > 1e-9
        if x.sum() <= least * (1 + gap) or not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, direction, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * direction, 0)
        x[out] = theta
        basis[:, out] = column
        enter(inverse, out, direction)
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for p in np.argsort(-x, kind="stable"):
        pattern = basis[:, p].round().astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(x[p] + 1e-6), (left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():
        pattern = first_fit(sizes, left, capacity).astype(np.int64)
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, tokens: bool = True, together: int = TOGETHER, remembered: int = REMEMBERED) -> DataFrame:
    """Every document's ids in sequences of at most `length` tokens with little padding.

    docs: doc_id, text; other columns are ignored; a repeated row is packed again. Documents are cut into full sequences and one rest; rests
    are classed by length (rounded up to GRID), the histogram of classes is planned by cutting_stock(), and the rests
    of each class, ranked, take the plan's places. Returns a row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id (from 0), offset, and, if `tokens`, ids. A null or empty text is the one id END. Rows
    without a doc_id are left out; an empty table gives no sequences. The plan's size depends on the number of classes
    only, not on the number of documents. together, remembered: memory against time of the encoder, no result.
    """
    pieces = cut(docs, path, length, tokens, together, remembered)
    if not tokens:
        pieces = pieces.drop("ids")
    kind = F.ceil(F.col("length") / GRID).cast("int")  # a full sequence is the largest class
    pieces = common.checkpoint(pieces.withColumn("kind", F.when(F.col("length") == length, -1).otherwise(kind)))
    counts = {r["kind"]: r["n"] for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    full = counts.pop(-1, 0)
    sizes = np.array(sorted(counts), np.int64)
    plan = cutting_stock(sizes, np.array([counts[int(s)] for s in sizes], np.float64), length // GRID)
    places: dict[int, list[tuple[int, int, int]]] = {-1: [(0, 1, 0)]}
    used, sequence = dict.fromkeys(sizes.tolist(), 0), full
    for pattern, times in plan:
        for i in np.flatnonzero(pattern).tolist():
            size, each = int(sizes[i]), int(pattern[i])
            places.setdefault(size, []).append((used[size], each, sequence))
            used[size] += each * times
        sequence += times
    lookup = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in places.items()}

    buckets = max(64, (full + int(sum(counts.values()))) // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    cells = pieces.groupBy("kind", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start")
    ranked = pieces.withColumn("own", F.row_number().over(own)).join(cells, ["kind", "bucket"]).withColumn("rank", F.col("ahead") + F.col("own") - 1)

    @common.tidy_rows
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ranks = batch.column("kind").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == k)
                first, each, base = lookup[k]
                p = np.searchsorted(first, ranks[at], "right") - 1
                out[at] = base[p] + (ranks[at] - first[p]) // each[p]
            columns = [batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(out, pa.int64())], names=[*names, "sequence_id"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if tokens else [])]
    placed = ranked.select(*names, "kind", "rank").mapInArrow(place, ", ".join(f"{c} {'array<int>' if c == 'ids' else 'long'}" for c in names) + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
