"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts as one state with an arc for every byte. Each merge (u, v) -> w then applies one gadget: the arcs
labelled u are led to a copy of their target that has no arc v (u followed by v would have been merged), and every
state with an arc u gets an arc w to where v led. After all merges, a path from the start reads exactly the correct
tokenisation of the string that its labels spell, so encoding a word is a walk: from every position reached, follow
the arcs whose labels come next; each position is reached by one token only.

Tables: an arc w exists in a state exactly if the arc of its left part did when w was made. Numbering tokens by the
tree of left parts, later children first, makes what a copy lacks a run of numbers; a state is a chain of such runs
and is flattened to sorted bounds when first used.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes of words and ids that a worker remembers, and the longest word that it does; the memory is emptied when full, which changes no result.
REMEMBERED, REMEMBERED_WORD = 150_000_000, 200
#: Bytes beyond which a word is walked position by position, with a number for each, not with a stack.
LONG_WORD = 10_000
#: The public pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that the pattern never crosses. Python's white space holds four separators more than the pattern's.
PIECES, ODD_SPACE = re.compile(r" ?\S+|\s+(?!\S)|\s"), re.compile("[\x1c-\x1f]")


def printable_bytes() -> dict[str, int]:
    """The vocabulary file's character for each byte: itself if it prints in Latin-1, else one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled automaton of a vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        to_byte, vocab = printable_bytes(), held["model"]["vocab"]
        self.label = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.label |= {i: t.encode() for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._compile(merges)
        self.split = regex.compile(PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memory: dict[str, tuple[int, ...]] = {}
        self.remembered = 0

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        left = {w: (u, v) for u, v, w in merges}
        made = {w: k for k, (_, _, w) in enumerate(merges)}
        rank = {(u, v): k for k, (u, v, _) in enumerate(merges)}
        base = [t for t in self.label if len(self.label[t]) == 1 and t not in left]
        children: dict[int, list[int]] = {}
        for _, (u, _, w) in enumerate(merges):
            children.setdefault(u, []).append(w)
        number, end, ahead = {}, {}, 0
        stack = [(t, False) for t in base]
        while stack:  # later children first, so that what is newer than a merge is a run behind its token
            t, over = stack.pop()
            if over:
                end[t] = ahead
                continue
            number[t] = ahead
            ahead += 1
            stack.append((t, True))
            stack += [(w, False) for w in children.get(t, ())]
        for t, c in children.items():
            children[t] = [made[w] for w in c]  # ascending

        def joins_earlier(u: int, v: int, k: int) -> bool:
            """Whether u and v side by side would have merged across their border before merge k."""
            until = k
            while True:
                b, newest = v, k
                while True:
                    r = rank.get((u, b), until)
                    if r < until and r <= newest:
                        return True
                    if b not in left:
                        break
                    newest, b = made[b], left[b][0]
                if u not in left:
                    return False
                until, u = min(until, made[u]), left[u][1]

        self.number = number
        self.parent, self.low, self.high = [-1], [0], [0]
        self.target = dict.fromkeys(base, 0)
        dead = set()
        for k, (u, v, w) in enumerate(merges):
            if u in dead or v in dead or joins_earlier(u, v, k):
                dead.add(w)
                self.target[w] = 0
                continue
            old, after_v = self.target[u], self.target[v]
            newer = children.get(v, ())
            first_older = bisect_right(newer, k - 1) - 1  # of the children, the last made before this merge
            high = number[merges[newer[first_older]][2]] if first_older >= 0 else end[v]
            self.parent.append(old)
            self.low.append(number[v])
            self.high.append(high)
            self.target[u] = len(self.parent) - 1
            self.target[w] = after_v
        self.bounds: dict[int, list[int]] = {0: []}
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t in chain(base, (w for _, _, w in merges)):
            if t in dead:
                continue
            node = 0
            for b in self.label[t]:
                key = node << 8 | b
                if key not in self.next:
                    self.next[key] = len(self.token)
                    self.token.append(-1)
                node = self.next[key]
            self.token[node] = t

    def flat(self, state: int) -> list[int]:
        """Ascending bounds of the runs of numbers that a state lacks: inside one if an odd count of bounds is <= the number."""
        runs, at = [], state
        while at:
            runs.append((self.low[at], self.high[at]))
            at = self.parent[at]
        out: list[int] = []
        for a, b in sorted(runs):
            if out and a <= out[-1]:
                out[-1] = max(out[-1], b)
            else:
                out += [a, b]
        self.bounds[state] = out
        return out

    def arcs(self, word: bytes, at: int) -> list[tuple[int, int]]:
        """(end, token) of all labels that stand in word at `at`, the shortest first."""
        step, token, node, out = self.next, self.token, 0, []
        for i in range(at, len(word)):
            node = step.get(node << 8 | word[i])
            if node is None:
                break
            if token[node] >= 0:
                out.append((i + 1, token[node]))
        return out

    def walk(self, word: bytes) -> list[int]:
        """The tokens of a pre-split word: the one path that spells it.

        Long arcs are tried first; a token after which the rest can't be spelt is noted and never tried there again, so
        the work is bounded by the arcs of the word.
        """
        n, number, target, bounds = len(word), self.number, self.target, self.bounds
        if not n:
            return []
        if n > LONG_WORD:
            return self.walk_long(word)
        path: list[int] = []
        ends, states, open_arcs, dead = [0], [0], [self.arcs(word, 0)], set()
        known: dict[int, list[tuple[int, int]]] = {}
        while True:
            lacks = bounds.get(states[-1])
            if lacks is None:
                lacks = self.flat(states[-1])
            left = open_arcs[-1]
            while left:
                end, t = left.pop()
                if bisect_right(lacks, number[t]) & 1 or (end, t) in dead:
                    continue
                path.append(t)
                if end == n:
                    return path
                ends.append(end)
                states.append(target[t])
                if end not in known:
                    known[end] = self.arcs(word, end)
                open_arcs.append(known[end].copy())
                break
            else:
                dead.add((ends.pop(), path.pop()))
                states.pop()
                open_arcs.pop()

    def walk_long(self, word: bytes) -> list[int]:
        """As walk(): every position that can be reached is reached by one token only, so that token is all to remember."""
        by = np.full(len(word) + 1, -1, np.int32)
        for at in range(len(word)):
            if at and by[at] < 0:
                continue
            state = self.target[int(by[at])] if at else 0
            lacks = self.bounds.get(state)
            if lacks is None:
                lacks = self.flat(state)
            for end, t in self.arcs(word, at):
                if not bisect_right(lacks, self.number[t]) & 1:
                    by[end] = t
        path, at = [], len(word)
        while at:
            path.append(int(by[at]))
            at -= len(self.label[path[-1]])
        return path[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        words, memory = self.split.findall(piece), self.memory
        if len(words) == 1:
            ids = tuple(self.walk(piece.encode()))
            if len(piece) <= REMEMBERED_WORD:
                if self.remembered >= REMEMBERED:
                    memory.clear()
                    self.remembered = 0
                memory[piece] = ids
                self.remembered += 200 + 4 * len(piece) + 8 * len(ids)
            return ids
        return tuple(chain.from_iterable(memory.get(w) or self._piece(w) for w in words))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a special token's own text becomes its id."""
        out: list[int] = []
        for i, part in enumerate(self.marks.split(text)) if self.marks else ((0, text),):
            if i % 2:
                out.append(self.special[part])
            elif ODD_SPACE.search(part):
                for w in self.split.findall(part):
                    out += self.walk(w.encode())
            else:
                memory = self.memory
                for piece in PIECES.findall(part):
                    out += memory.get(piece) or self._piece(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """One compiled automaton for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Automaton(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every whole text encoded, and decoded again if `decode`.

    path: a byte-level BPE file of the tokenizers library, found at the same place on every worker. A null or empty
    text gives no ids and an empty string; rows without a doc_id are left out; a repeated row gives its row again; other
    columns are ignored; an empty table gives an empty result; very long words cost time and memory in proportion to
    their length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in common.slices(batches, 500):
            texts = batch.column("text").to_pylist()
            ids = [machine.encode(t) if t else [] for t in texts]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            decoded = [machine.decode(i).decode("utf-8", "replace") if decode else None for i in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of bpe_encode()'s rows."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
