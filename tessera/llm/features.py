"""Sparse text features: hashed n-grams over runs of letters and runs of marks."""

from __future__ import annotations

import numpy as np

from tessera.llm import textkit

BITS = 18
#: Odd multipliers of the polynomial hashes modulo 2**64; a clash of two features costs a little accuracy, never a wrong row.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: The hash of every bigram of a token with itself.
REPEAT = 0xA24BAED4963EE407


#: Powers that are kept; those for a longer text go with it.
KEPT_POWERS = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= KEPT_POWERS:
            _powers[base] = have
    return have[: n + 1]


class Prefix:
    """Hash of any slice of a sequence of uint64 values in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(base, n)[:n], out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), n)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return textkit.mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def token_hashes(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of all tokens, for each text its first token and the one after its last, and for each length in
    `prefixes` the longer tokens and the hashes of their first so many bytes.

    A token is a run of letters, digits and bytes from 0x80 on, or a run of other marks; white space divides.
    """
    buf, lo, hi = textkit.joined(texts)
    kind = np.full(256, 2, np.int8)
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[[32, *range(9, 14)]] = 0
    run = kind[buf]
    edge = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[edge[1:], len(run)]
    held = run[edge] > 0
    starts, ends = edge[held], ends[held]
    prefix = Prefix(buf.astype(np.uint64) + np.uint64(1), BYTE_BASE)
    heads = []
    for n in prefixes:
        longer = np.flatnonzero(ends - starts > n)
        heads.append((longer, textkit.mix(prefix.slices(starts[longer], starts[longer] + n) + np.uint64(n))))
    return prefix.slices(starts, ends), np.searchsorted(starts, lo), np.searchsorted(starts, hi), heads


def sparse(texts: list[bytes], ngrams: int = 2, bits: int = BITS, presence: bool = False, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row ends of the texts' n-grams up to `ngrams` tokens, hashed to 2**bits slots.

    `prefixes`: also the first so many bytes of longer tokens, so that inflected forms share a slot.

    A token followed by itself is one bigram whatever the token, so repetition shows in words never seen before.
    A value is 1 + log(count), scaled so that a row has length one; with `presence` it is 1. No token: no slot.
    """
    hashes, lo, hi, heads = token_hashes(texts, prefixes)
    rows, slots = [], []
    for longer, head in heads:
        rows.append(np.searchsorted(hi, longer, "right"))
        slots.append((head >> np.uint64(64 - bits)).astype(np.int64))
    h = hashes
    for n in range(1, ngrams + 1):
        if n > 1:
            same = h[:-1] == hashes[1:] if n == 2 else np.zeros(max(len(h) - 1, 0), bool)
            h = textkit.mix(h[:-1] * np.uint64(WORD_BASE) + hashes[n - 1 :])
            h[same] = np.uint64(REPEAT)
        count = np.maximum(hi - lo - n + 1, 0)
        rows.append(np.repeat(np.arange(len(texts)), count))
        slots.append((h[textkit.ragged_windows(lo, count)] >> np.uint64(64 - bits)).astype(np.int64))
    key = (np.concatenate(rows) << bits) | np.concatenate(slots)
    key, count = np.unique(key, return_counts=True)
    row, slot = key >> bits, (key & (1 << bits) - 1).astype(np.int32)
    ends = np.searchsorted(row, np.arange(len(texts)), "right")
    if presence:
        return slot, np.ones(len(slot), np.float32), ends
    value = 1 + np.log(count)
    value /= np.sqrt(np.bincount(row, value * value, len(texts)))[row] if len(row) else 1
    return slot, value.astype(np.float32), ends


def dots(weights: np.ndarray, slot: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sparse dot product of each row with the weights."""
    sums = np.r_[0.0, np.cumsum(weights[slot].astype(np.float64) * value)]
    return sums[ends] - sums[np.r_[0, ends[:-1]]] if len(ends) else np.zeros(0)
