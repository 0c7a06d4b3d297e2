"""Vectorised text work on UTF-8 buffers: words, hashes of slices and minimiser seeds."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the chained hashes.
STEP, SECOND = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Units of the blocks that slices are hashed by, at most.
BLOCK = 8


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slices:
    """Hashes of slices of a sequence of units, each of at least `least` units.

    A slice is a chain of blocks of up to eight units, the last one laid at its end. A block of bytes is the bytes
    themselves; a block of word hashes is mixed pair by pair. Each link is mixed, so the hash is no polynomial whose zeros
    could be planned for.
    """

    def __init__(self, values: np.ndarray, least: int, byte: bool):
        self.size = min(BLOCK, 1 << (max(least, 1).bit_length() - 1))
        block, have = values.astype(np.uint64), 1
        while have < self.size:
            low, high = block[:-have], block[have:]
            block = (low << np.uint64(8 * have)) | high if byte else mix((low * np.uint64(STEP)) ^ (high + np.uint64(have)))
            have *= 2
        self.blocks = block

    def hash(self, starts: np.ndarray, lengths, seed: int = STEP) -> np.ndarray:
        """lengths: one number for all slices, or one for each."""
        every = np.isscalar(lengths)
        most = int(lengths if every else lengths.max()) if len(starts) else 0
        last = starts + (lengths - self.size)
        h = np.full(len(starts), seed, np.uint64) ^ (np.uint64(lengths) if every else lengths.astype(np.uint64))
        for at in range(0, most, self.size):
            linked = mix((h * np.uint64(STEP)) ^ self.blocks[np.minimum(starts + at, last)])
            h = linked if every else np.where(at < lengths, linked, h)
        return h


def separators(buf: np.ndarray) -> np.ndarray:
    """Space and the control characters tab to carriage return."""
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with a line feed after each; where each starts and ends."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]] if len(texts) else np.zeros(0, np.int64)
    return buf, starts, starts + lengths


def word_spans(buf: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words between separators; buf ends with a separator."""
    word = ~(separators(buf) if sep is None else sep)
    edge = np.diff(np.r_[False, word].view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list[bytes]):
    """buf, word starts, word ends, and for each text the first word and the one after its last."""
    buf, lo, hi = joined(texts)
    starts, ends = word_spans(buf)
    return buf, starts, ends, np.searchsorted(starts, lo), np.searchsorted(starts, hi)


def word_hashes(texts: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word of all texts, one after another."""
    words = [w for t in texts for w in t.split()]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i that has it whole."""
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (w - have)], m[w - have :]) if w > have else m


def offset_type(window: int, gram: int) -> np.dtype:
    """Holds every place that a gram can have in a window."""
    return np.min_scalar_type(max(window - gram, 1))


def seeds(values: np.ndarray, byte: bool, lo: np.ndarray, hi: np.ndarray, window: int, gram: int, wide: bool = False) -> tuple[dict[str, np.ndarray], Slices]:
    """Minimiser seeds of every window of `window` units in the pieces values[lo[i]:hi[i]], and the hasher.

    Each window picks the gram (of `gram` units) with the least hash, leftmost first, so equal windows pick alike
    wherever they stand. A row covers the run of windows that pick the same place: piece, at (of the gram, from the
    piece's start), left and right (windows start at - left ... at - right), key (hash of the gram), and what context()
    adds.
    """
    count = np.maximum(hi - lo - window + 1, 0)
    slices = Slices(values, gram, byte)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return context({"piece": none, "at": none, "left": none, "right": none, "key": none.astype(np.uint64)}, slices, none, window, gram, wide), slices
    at = np.arange(len(values) - gram + 1)
    key = slices.hash(at, gram)
    order = (key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    picked = (sliding_min(order, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = ragged_windows(lo, count)
    anchor, piece = picked[starts], np.repeat(np.arange(len(lo)), count)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
    last = np.r_[first[1:], len(starts)] - 1
    anchor, piece, begin, end = anchor[first], piece[first], starts[first], starts[last]
    return context({"piece": piece, "at": anchor - lo[piece], "left": anchor - begin, "right": anchor - end, "key": key[anchor]}, slices, lo, window, gram, wide), slices


def sides(slices: Slices, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the gram with the `half` units before it and with those behind it; zero if no window of the run holds those.

    Every window holds one of the two, so seeds of one key that share neither share no window.
    """
    half = -(-(window - gram) // 2)
    out = np.zeros((2, len(anchor)), np.uint64)
    for row, held, start in ((0, left >= half, anchor - half), (1, window - gram - right >= half, anchor)):
        at = np.flatnonzero(held)
        out[row, at] = slices.hash(start[at], gram + half) | np.uint64(1)
    return out[0], out[1]


def context(c: dict[str, np.ndarray], slices: Slices, lo: np.ndarray, window: int, gram: int, wide: bool) -> dict[str, np.ndarray]:
    """Adds context (64-bit hash of all that the windows of a row span, context2 for another 64 bits if `wide`), and before
    and after (16 bits each of sides(), not zero where the side is held)."""
    anchor, left, right = c["at"] + lo[c["piece"]], c["left"], c["right"]
    length = left - right + window
    before, after = sides(slices, anchor, left, right, window, gram)
    narrow = lambda x: np.where(x > 0, (x >> np.uint64(48)) | np.uint64(1), 0).astype(np.uint16)
    offset = offset_type(window, gram)
    out = {"piece": c["piece"].astype(np.int32), "at": c["at"].astype(np.uint32), "left": left.astype(offset), "right": right.astype(offset), "key": c["key"], "context": slices.hash(anchor - left, length)}
    if wide:
        out["context2"] = slices.hash(anchor - left, length, SECOND)
    return out | {"before": narrow(before), "after": narrow(after)}


def split_seeds(c: dict[str, np.ndarray], slices: Slices, lo: np.ndarray, window: int, gram: int, level: int, wide: bool) -> dict[str, np.ndarray]:
    """Seeds in narrower groups with the same windows: by the half before or behind the gram (level 1), or one for each window (2).

    Level 1 gives the windows with half the rest before their gram to the key of gram and that half, the others to the
    key of gram and the half behind. Equal windows meet as before, but fewer others with them.
    """
    left, right, half = c["left"].astype(np.int64), c["right"].astype(np.int64), -(-(window - gram) // 2)
    at, piece = c["at"].astype(np.int64), c["piece"]
    anchor = at + lo[piece]
    if level == 1:
        before, after = sides(slices, anchor, left, right, window, gram)
        b, a = np.flatnonzero(left >= half), np.flatnonzero(right < half)
        rows = np.r_[b, a]
        left, right = np.r_[left[b], np.minimum(left[a], half - 1)], np.r_[np.maximum(right[b], half), right[a]]
        key = np.r_[mix(before[b] ^ np.uint64(SECOND)), mix(after[a])]
    else:
        count = left - right + 1
        rows = np.repeat(np.arange(len(left)), count)
        left = right = np.repeat(right, count) + ragged_windows(np.zeros(len(count), np.int64), count)
        key = mix(slices.hash(anchor[rows] - left, window) + np.uint64(SECOND))
    out = context({"piece": piece[rows], "at": at[rows], "left": left, "right": right, "key": key}, slices, lo, window, gram, wide)
    one = np.uint16(1)  # all of a group of halves share that half
    if level == 1:
        out["before"][: len(b)] = one
        out["after"][len(b) :] = one
    return out


def ragged_windows(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The window starts lo[i] ... lo[i] + count[i] - 1 of every piece."""
    total = int(count.sum())
    return np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
