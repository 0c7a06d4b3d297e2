"""SimHash near-duplicates found by a generalised pigeonhole over partitions of correlated bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textkit

#: Fingerprints that the bit statistics are taken from, at most (a bounded, hash-ordered sample; all are indexed).
SAMPLE = 8000
#: Signatures for each bucket of the probe, members of a group compared in one block, and rows of a group in one task.
BUCKET_ROWS, BLOCK, GROUP_ROWS = 400_000, 4096, 20_000
#: Texts and characters of each that the order of shingles is taken from, text for each bucket, partners of a document in one task.
SETS_SAMPLE, SAMPLE_CHARS, SET_BYTES, PARTNERS = 2000, 4000, 8_000_000, 250
#: Masks of a threshold at most.
MASKS = 600
#: Pairs that a task holds before it hands them on.
PAIRS = 2_000_000
#: Rows of a small side that are broadcast, at most; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Texts that are compared in one task; deviations of a distance that rule a pair of sets of LARGE or more shingles out.
ASKED, DEVIATIONS, LARGE = 250, 10, 64
#: Multipliers that derive further 64-bit words of a wide fingerprint from a shingle's hash.
WORD_STEP = 0x9E3779B97F4A7C15


def fingerprint_words(text: bytes, ngram: int, words: int) -> np.ndarray:
    """The SimHash of a text as `words` uint64 values: a bit is 1 if it is set in over half of the shingles' hashes.

    Words are what lies between space and tab to carriage return, A-Z lower-cased. Fewer words than `ngram` make one
    shingle of the whole sequence; no word makes zero.
    """
    w = text.lower().split()
    if not w:
        return np.zeros(words, np.uint64)
    whole = b" ".join(w)
    if len(w) <= ngram:
        shingles = [whole]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.r_[0, ends[:-ngram]]
        shingles = [whole[a:b] for a, b in zip(starts.tolist(), (ends[ngram - 1 :] - 1).tolist(), strict=True)]
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles), np.uint64, len(shingles))
    out = np.zeros(words, np.uint64)
    for k in range(words):
        v = h if k == 0 else textkit.mix(h + np.uint64(k * WORD_STEP & (1 << 64) - 1))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(v), 1 << 16):
            ones += np.unpackbits(v[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, ngram: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fingerprint binary, big-endian) of every row with a doc_id; a null text counts as empty."""
    words = bits // 64

    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.text_list(batch)
            out = [fingerprint_words(t, ngram, words).astype(">u8").tobytes() for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, fingerprint binary")


def partition_bits(sample: np.ndarray, parts: int) -> list[np.ndarray]:
    """Bits in `parts` groups of about equal size, correlated ones together, so that what varies little shares a group.

    sample: rows of 0 and 1. Each group starts from the bit most correlated with any free one and takes, again and
    again, the free bit most correlated with its members.
    """
    bits = sample.shape[1]
    x = sample - sample.mean(axis=0)
    scale = np.sqrt((x * x).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(scale, scale), 1e-9)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(bits)), []
    for size in [len(a) for a in np.array_split(np.arange(bits), parts)]:
        left = sorted(free)
        first = max(left, key=lambda b: (corr[b, left].max() if len(left) > 1 else 0, -b))
        group = [first]
        free.discard(first)
        pull = corr[first].copy()
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (pull[b], -b))
            group.append(best)
            free.discard(best)
            pull += corr[best]
        groups.append(np.array(sorted(group)))
    return groups


def variants(width: int, radius: int) -> np.ndarray:
    """Every mask of `width` bits with at most `radius` ones."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def group_values(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The bits of `group` of each fingerprint as one number. Bit 0 is the first word's highest."""
    out = np.zeros(len(words), np.uint64)
    for b in group.tolist():
        out = (out << np.uint64(1)) | ((words[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
    return out


def allocate(counts: np.ndarray, budget: int) -> tuple[int, list[int]]:
    """Thresholds -1, 0, 1 ... for each group that add up to `budget` at the least estimated cost, by dynamic programming.

    counts[i, t + 1]: estimated cost of group i at threshold t (-1: the group is not probed).
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in counts:
        grown: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, taken) in best.items():
            for t in range(-1, len(row) - 1):
                key, value = total + t, cost + row[t + 1]
                if key not in grown or value < grown[key][0]:
                    grown[key] = (value, [*taken, t])
        best = grown
    return best[budget]


def meetings(values: np.ndarray, width: int, radius: int) -> np.ndarray:
    """For t = 0 ... radius the share of pairs of the sample whose values of one group differ in at most t bits."""
    n = len(values)
    out = np.zeros(radius + 1)
    if n < 2:
        return out
    keys, count = np.unique(values, return_counts=True)
    if width <= 16:
        table = np.zeros(1 << width, np.int64)
        table[keys.astype(np.int64)] = count
    for t in range(radius + 1):
        for c in combinations(range(width), t):
            other = keys ^ np.uint64(sum(1 << b for b in c))
            if width <= 16:
                both = table[other.astype(np.int64)]
            else:
                at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
                both = np.where(keys[at] == other, count[at], 0)
            out[t:] += float((count * (both - (t == 0))).sum())
    return out / (n * (n - 1.0))


def plan(sample: np.ndarray, n: int, bits: int, radius: int, most: int = 2) -> tuple[list[np.ndarray], list[int]]:
    """Groups of bits and their thresholds for all pairs within `radius` bits among n fingerprints.

    By the generalised pigeonhole principle a pair within the radius agrees to within its threshold on some group if
    the thresholds add up to radius - groups + 1. For every number of groups, the expected candidates and the signatures
    written are weighed, and the cheapest plan wins. Candidates are counted on the sample, as the bits of a group are
    correlated: pairs whose values meet within the threshold. What a sample of this size cannot show is taken from the bits'
    rates as if they were independent. Thresholds of more than MASKS masks are never cheap and are not counted.
    """
    unpacked = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(len(sample), -1), axis=1)[:, :bits].astype(np.float32)
    plans = []
    for parts in range(2, radius + 2) if radius else (1,):
        groups = partition_bits(unpacked, parts)
        costs = np.full((parts, min(most, radius) + 2), np.inf)
        costs[:, 0] = 0
        for i, g in enumerate(groups):
            if len(g) > 64:  # more bits than a signature holds
                continue
            p = unpacked[:, g].mean(axis=0)
            agree = np.prod(p * p + (1 - p) * (1 - p))  # two fingerprints agree on the whole group
            masks = np.cumsum([math.comb(len(g), r) for r in range(min(most, radius) + 1)])
            counted = meetings(group_values(sample, g), len(g), int((masks <= MASKS).sum()) - 1)
            for t in range(len(counted)):
                meet = max(counted[t], agree * masks[t])
                costs[i, t + 1] = n * masks[t] * 8.0 + n * (n * meet) * 0.02
        try:
            cost, thresholds = allocate(costs, radius - parts + 1)
        except KeyError:
            continue
        if math.isfinite(cost):
            plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda p: p[:2])
    return groups, thresholds


def signature_keys(w: np.ndarray, groups: list[np.ndarray], masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of every fingerprint's values and changed values, and whose they are."""
    keys, at = [], []
    for i, (g, m) in enumerate(zip(groups, masks, strict=True)):
        if len(m):
            own = group_values(w, g)
            keys.append(textkit.mix(((own[:, None] ^ m[None, :]) + np.uint64((i + 1) * WORD_STEP & (1 << 64) - 1)).ravel()))
            at.append(np.repeat(np.arange(len(w)), len(m)))
    none = np.zeros(0, np.int64)
    return (np.concatenate(keys), np.concatenate(at)) if keys else (none.astype(np.uint64), none)


def hot_keys(sample: np.ndarray, n: int, groups: list[np.ndarray], masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that more than GROUP_ROWS rows are expected to share, ascending, and in how many parts each is cut."""
    keys, count = np.unique(signature_keys(sample, groups, masks)[0], return_counts=True)
    expected = count * (n / max(len(sample), 1))
    hot = expected > GROUP_ROWS
    return keys[hot], np.ceil(expected[hot] / (GROUP_ROWS / 2)).astype(np.int64)


def cut_hot(key: np.ndarray, at: np.ndarray, ident: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their rows; every two parts of a hot group meet under a key of their own. ident: the id behind each key."""
    slot = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
    warm = np.flatnonzero(hot[slot] == key) if len(hot) else np.zeros(0, np.int64)
    if not len(warm):
        return key, at
    n_parts = parts[slot[warm]]
    own = np.repeat((textkit.mix(ident[warm].astype(np.uint64)) % n_parts.astype(np.uint64)).astype(np.int64), n_parts)
    other = common.ragged(np.zeros(len(warm), np.int64), n_parts)
    pair = (np.minimum(own, other) << 31 | np.maximum(own, other)).astype(np.uint64)
    keys_of_pairs = textkit.mix(np.repeat(key[warm], n_parts) ^ textkit.mix(pair + np.uint64(1)))
    cold = np.ones(len(key), bool)
    cold[warm] = False
    return np.r_[key[cold], keys_of_pairs], np.r_[at[cold], np.repeat(at[warm], n_parts)]


def to_words(column: pa.ChunkedArray | pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def links_in(key: np.ndarray, ident: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the groups of equal key: pairs (id, smallest id reachable in the bucket)."""
    order = np.lexsort((ident, key))
    key, ident, words = key[order], ident[order], words[order]
    starts, ends = common.runs_of(key)
    keep = ends - starts > 1
    starts, ends = starts[keep], ends[keep]
    nodes, index = np.unique(ident, return_inverse=True)
    a_all, b_all = [], []
    size = ends - starts
    small = size <= 64
    s, e = starts[small], ends[small]
    if len(s):  # pair each row with each later one of its group, a batch of groups at a time
        rows = common.ragged(s, e - s)
        later = np.repeat(e, e - s) - rows - 1
        for at in range(0, len(rows), 200_000):
            r, k = rows[at : at + 200_000], later[at : at + 200_000]
            a, b = np.repeat(r, k), common.ragged(r + 1, k)
            ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= radius
            a_all.append(a[ok])
            b_all.append(b[ok])
    for lo, hi in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        for i in range(lo, hi, 512):
            block = slice(i, min(hi, i + 512))
            for j in range(i, hi, BLOCK):
                other = slice(j, min(hi, j + BLOCK))
                a, b = np.nonzero(sum(np.bitwise_count(words[block, None, w] ^ words[None, other, w]).astype(np.uint16) for w in range(words.shape[1])) <= radius)
                a_, b_ = a + i, b + j
                root = common.local_roots(hi - lo, a_ - lo, b_ - lo)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a_all.append(moved + lo)
                b_all.append(root[moved] + lo)
    if not a_all:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = index[np.concatenate(a_all)], index[np.concatenate(b_all)]
    root = common.local_roots(len(nodes), a, b)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(distinct: DataFrame, bits: int, radius: int, sure: int) -> DataFrame:
    """distinct (id long, fingerprint binary, one row each) to links (a, b) that connect what pairs within `radius` bits connect.

    Every pair within `sure` bits is met for certain; of those between `sure` and `radius` the ones that agree on some
    group all the same. With sure = radius no link is missed.
    """
    spark, words = distinct.sparkSession, bits // 64
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("fingerprint").toArrow().column("fingerprint")
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    groups, thresholds = plan(to_words(sample, words), n, bits, sure)
    masks = [variants(len(g), t) if t >= 0 else np.zeros(0, np.uint64) for g, t in zip(groups, thresholds, strict=True)]
    buckets = max(96, n * sum(map(len, masks)) // BUCKET_ROWS)
    hot, parts = hot_keys(to_words(sample, words), n, groups, masks)

    @common.tidy_rows
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, w = batch.column("id").to_numpy(), to_words(batch.column("fingerprint"), words)
            key, at = signature_keys(w, groups, masks)
            key, at = cut_hot(key, at, ident[at], hot, parts)
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out: list[tuple[int, bytes]] = []
            for a, b in zip(*common.runs_of(bucket[order]), strict=True):
                r = order[a:b]
                out.append((int(bucket[r[0]]), common.pack(key=key[r], ident=ident[at[r]], **{f"w{k}": w[at[r], k] for k in range(words)})))
            yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])

    @common.tidy_group
    def probe_bucket(table: pa.Table) -> pa.Table:
        c = common.unpack_all(table.column("payload").to_pylist())
        a, b = links_in(c["key"], c["ident"], np.stack([c[f"w{k}"] for k in range(words)], axis=1), radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = distinct.select("id", "fingerprint").mapInArrow(signatures, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(probe_bucket, "a long, b long")


def radius_of(similarity: float, bits: int) -> int:
    """The bits in which fingerprints of two shingle sets of this Jaccard similarity are expected to differ.

    Sets of equal size with Jaccard s have the cosine 2 s / (1 + s), and a bit differs with the angle's share of pi.
    """
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def simhash_neardup(docs: DataFrame, ngram: int = 3, bits: int = 64, radius: int = 3, sure: int | None = None) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): documents whose fingerprints link at `radius` or fewer differing bits.

    sure: the distance up to which every link is found for certain (default: the radius); see links().

    docs: doc_id (unique), text; other columns are ignored. Links run over chains; component_id is the smallest doc_id
    reachable, the own one included. Null and empty texts have fingerprint zero and link like any other. Equal
    fingerprints are folded to one before the search and all keep their link. Rows without a doc_id are left out; an
    empty table gives an empty result.
    """
    prints = common.checkpoint(fingerprints(docs, ngram, bits))
    distinct = common.checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("id")))
    found = common.connected_components(links(distinct, bits, radius, radius if sure is None else sure))
    named = distinct.join(found, distinct.id == found.node, "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def shingle_sets(texts: list[bytes], ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, ascending, one text after another, and how many each has.

    Words and short texts as in fingerprint_words(); a text without words has none.
    """
    rows, hashes, at = [], [], 0
    for _, part in common.chunks(np.arange(len(texts)), texts):
        part = [t.lower() for t in part]
        n = np.fromiter((len(t.split()) for t in part), np.int64, len(part))
        lo, hi = np.cumsum(n) - n, np.cumsum(n)
        count = np.where(n > 0, np.maximum(n - ngram + 1, 1), 0)
        first, row = textkit.ragged_windows(lo, count), np.repeat(np.arange(len(part)), count)
        h = textkit.Slices(textkit.word_hashes(part), 1, False).hash(first, np.minimum(ngram, hi[row] - first))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        rows.append(row[new] + at)
        hashes.append(h[new])
        at += len(part)
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.bincount(np.concatenate(rows), minlength=len(texts))


def prefixes(hashes: np.ndarray, count: np.ndarray, similarity: float, known: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of each set in one order of all shingles (rare in the sample first): hash, whose, place in the order.

    Sets of Jaccard s or more share at least s of either, so they share one of the first n - ceil(s n) + 1 of each.
    known, seen: shingles that the sample holds more than once, ascending, and how often; any order is right.
    """
    row = np.repeat(np.arange(len(count)), count)
    often = np.zeros(len(hashes), np.int64)
    if len(known):
        slot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        often = np.where(known[slot] == hashes, seen[slot], 0)
    order = np.lexsort((hashes, often, row))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
    held = place < (count - np.ceil(similarity * count - 1e-9).astype(np.int64) + 1)[row]
    return hashes[order][held], row[held], place[held]


def meet(c: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ids, the smaller first, of different components that share a key and whose sizes and places allow the similarity.

    They come in runs of about PAIRS, each pair once in a run, so a key that very many sets share costs time, not memory.
    """
    order = np.lexsort((c["ident"], c["comp"], c["key"]))
    c = {k: v[order] for k, v in c.items()}
    key, comp, n = c["key"], c["comp"], c["n"].astype(np.int64)
    left = n - c["place"]  # what a pair can share from its first shared shingle on
    starts, ends = common.runs_of(key)
    end = np.repeat(ends, ends - starts)
    run = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])])
    run_end = np.repeat(np.r_[run[1:], len(key)], np.diff(np.r_[run, len(key)]))
    later = end - run_end
    rows = np.flatnonzero(later)
    found = np.zeros((0, 2), np.int64)
    batch = np.cumsum(later[rows]) // 500_000
    for lo, hi in zip(*common.runs_of(batch), strict=True):
        r = rows[lo:hi]
        a, b = np.repeat(r, later[r]), common.ragged(run_end[r], later[r])
        ok = np.minimum(left[a], left[b]) >= similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9
        a, b = c["ident"][a[ok]], c["ident"][b[ok]]
        found = np.unique(np.r_[found, np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)], axis=0)
        if len(found) > PAIRS:
            yield found[:, 0], found[:, 1]
            found = found[:0]
    if len(found):
        yield found[:, 0], found[:, 1]


def small(rows: DataFrame) -> DataFrame:
    """A checkpointed side of a join, broadcast if it has at most BROADCAST rows."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def shared_prefixes(docs: DataFrame, held: DataFrame, ngram: int, similarity: float, size: int) -> DataFrame:
    """docs (doc_id, text) for a sample, held (id, text, comp) to every pair (a, b) of ids of different components whose shingle sets can reach the similarity."""
    n = docs.count()
    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SETS_SAMPLE))) == 0).limit(2 * SETS_SAMPLE)
    sample = sampled.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).toArrow()
    hashes, count = shingle_sets([(t or "").encode() for t in sample.column("text").to_pylist()], ngram)
    known, seen = np.unique(hashes, return_counts=True)
    known, seen = known[seen > 1], seen[seen > 1]
    hot, times = np.unique(prefixes(hashes, count, similarity, known, seen)[0], return_counts=True)
    expected = times * (n / max(len(count), 1))
    hot, parts = hot[expected > GROUP_ROWS], np.ceil(expected[expected > GROUP_ROWS] / (GROUP_ROWS / 2)).astype(np.int64)
    buckets = max(96, size // SET_BYTES)

    @common.tidy_rows
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ident, comp = batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            h, count = shingle_sets([t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()], ngram)
            key, row, place = prefixes(h, count, similarity, known, seen)
            key, at = cut_hot(key, np.arange(len(key)), ident[row], hot, parts)
            row, place, key = row[at], place[at].astype(np.uint32), textkit.mix(key)
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out: list[tuple[int, bytes]] = []
            for a, b in zip(*common.runs_of(bucket[order]), strict=True):
                r = order[a:b]
                out.append((int(bucket[r[0]]), common.pack(key=(key[r] >> np.uint64(32)).astype(np.uint32), ident=ident[row[r]], above=ident[row[r]] - comp[row[r]], n=count[row[r]].astype(np.uint32), place=place[r])))
            yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])

    def probe_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = common.unpack_all([p for batch in batches for p in batch.column("payload").to_pylist()])  # 32 bits of a key: a chance meeting is undone by similar()
        for a, b in meet({**c, "comp": c["ident"] - c["above"]}, similarity) if c else ():
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        common.release()

    sent = held.select("id", "comp", "text").mapInArrow(signatures, "bucket int, payload binary")
    return sent.groupBy("bucket").applyInArrow(probe_bucket, "a long, b long")


def similar(pairs: DataFrame, docs: DataFrame, ngram: int, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have the Jaccard similarity; a's many partners are cut into parts.

    Only texts that occur in a pair are shuffled, unless there are more than BROADCAST of those. Of different texts of
    one id the least is compared.
    """
    pairs = common.checkpoint(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    many = pairs.groupBy("a").count().where(F.col("count") > PARTNERS)
    pairs = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.expr(f"pmod(xxhash64(b), 1 + `count` div {PARTNERS})"), F.lit(0)).alias("part"))
    asked = common.checkpoint(pairs.select("a", "part", F.col("b").alias("id")).unionByName(pairs.select("a", "part", F.col("a").alias("id")).distinct()))
    buckets = max(96, size // SET_BYTES, asked.count() // ASKED)
    sent = docs.select(F.col("doc_id").alias("id"), "text").join(small(asked), "id").select(F.expr(f"pmod(xxhash64(a, part), {buckets})").alias("bucket"), "a", "id", "text")

    @common.tidy_group
    def compare(table: pa.Table) -> pa.Table:
        a, ident, texts = table.column("a").to_numpy(), table.column("id").to_numpy(), [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        order = np.lexsort((ident, a))
        if not ((np.diff(a[order]) != 0) | (np.diff(ident[order]) != 0)).all():  # rows that share an id
            least = {(a[i], ident[i]): i for i in sorted(range(len(texts)), key=texts.__getitem__, reverse=True)}
            order = np.array(sorted(least.values()))
            a, ident, texts = a[order], ident[order], [texts[i] for i in order.tolist()]
        h, count = shingle_sets(texts, ngram)
        codes, code = np.unique(h, return_inverse=True)
        row = np.repeat(np.arange(len(a)), count)
        _, group = np.unique(a, return_inverse=True)
        heads = np.full(group.max() + 1, -1)
        heads[group[a == ident]] = np.flatnonzero(a == ident)
        head = heads[group]
        place = head[row] * len(codes) + code
        own = np.sort(place[head[row] == row])
        hit = own[np.minimum(np.searchsorted(own, place), len(own) - 1)] == place if len(own) else np.zeros(len(place), bool)
        both = np.bincount(row[hit], minlength=len(a))
        ok = (ident != a) & (both >= similarity * (count + count[head] - both) - 1e-9)
        return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(ident[ok], pa.int64())})

    return common.checkpoint(sent.groupBy("bucket").applyInArrow(compare, "a long, b long"))


def set_fingerprints(hashes: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of each set of shingles as `words` uint64 values; an empty set makes zero."""
    out = np.zeros((len(count), words), np.uint64)
    held = np.flatnonzero(count)
    ends = np.cumsum(count[held])
    for lo, hi in zip(*common.runs_of(ends // 200_000), strict=True):
        first, last = ends[lo] - count[held[lo]], ends[hi - 1]
        starts = ends[lo:hi] - count[held[lo:hi]] - first
        for k in range(words):
            v = textkit.mix(hashes[first:last] + np.uint64(k * WORD_STEP & (1 << 64) - 1))
            bits = np.unpackbits(v.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[held[lo:hi], k] = np.packbits(ones * 2 > count[held[lo:hi], None], axis=1).view(">u8").ravel()
    return out


def set_digests(docs: DataFrame, ngram: int, bits: int) -> DataFrame:
    """(doc_id, digest of the shingle set, its size and fingerprint) of every row with a doc_id; a null text counts as empty."""
    words = bits // 64

    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            ids, texts = common.text_list(batch)
            h, count = shingle_sets(texts, ngram)
            ends = np.cumsum(count)
            digests = [xxhash.xxh128_digest(h[a:b].tobytes()) for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
            prints = [w.tobytes() for w in set_fingerprints(h, count, words).astype(">u8")]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(count, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "digest", "size", "fingerprint"])

    return docs.mapInArrow(run, "doc_id long, digest binary, size long, fingerprint binary")


def not_far(pairs: DataFrame, distinct: DataFrame, bits: int, similarity: float, deviations: float = DEVIATIONS) -> DataFrame:
    """Pairs (a, b) without those of two large sets whose fingerprints are so many standard deviations too far apart."""
    p = radius_of(similarity, bits) / bits
    most = radius_of(similarity, bits) + math.ceil(deviations * math.sqrt(bits * p * (1 - p)))

    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = np.bitwise_count(to_words(batch.column("x"), bits // 64) ^ to_words(batch.column("y"), bits // 64)).sum(axis=1, dtype=np.int64)
                near = (apart <= most) | (np.minimum(batch.column("m").to_numpy(), batch.column("n").to_numpy()) < LARGE)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    sets = distinct.groupBy("id").agg(F.min("size").alias("size"), F.min("fingerprint").alias("fingerprint"))
    held = pairs.distinct().join(sets.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("fingerprint").alias("x")), "a")
    held = held.join(sets.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("fingerprint").alias("y")), "b")
    return held.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_neardup(docs: DataFrame, ngram: int, similarity: float, bits: int, sure: int, deviations: float = DEVIATIONS) -> DataFrame:
    """(doc_id, component_id): documents whose sets of `ngram`-word shingles have a Jaccard similarity of at least `similarity`.

    Fingerprints propose links first, as in simhash_neardup(), one for each document; then every pair of documents not
    yet connected that shares one of the first shingles of its sets is proposed, so no pair of the similarity is missed,
    but for large sets whose fingerprints are `deviations` standard deviations too far apart (at ten the chance is beyond
    1e-20; infinite: none is left out). Every proposed link is decided by the Jaccard similarity of the two sets. Equal sets (also two without words) are folded to one;
    links run over chains and component_id is the smallest doc_id reachable. Rows without a doc_id are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    _, size = common.rows_and_bytes(docs)
    prints = common.checkpoint(set_digests(docs, ngram, bits))
    distinct = common.checkpoint(prints.groupBy("digest").agg(F.first("fingerprint").alias("fingerprint"), F.first("size").alias("size"), F.min("doc_id").alias("id")))
    # one proposed link for each document: what these do not join, or join wrongly, is left to the shared shingles
    near = links(distinct.select("id", "fingerprint"), bits, radius_of(similarity, bits), sure).groupBy("a").agg(F.min("b").alias("b"))
    first = similar(near, docs, ngram, similarity, size)
    found = common.checkpoint(common.connected_components(first).where("node <> component"))
    copies = prints.select("doc_id").distinct().join(distinct.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    marks = common.checkpoint(found.select(F.col("node").alias("doc_id"), F.col("component").alias("comp")).unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("comp"))).withColumn("marked", F.lit(True)))
    labelled = docs.join(small(marks), "doc_id", "left").where("marked IS NULL OR comp IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.coalesce("comp", "doc_id").alias("comp"))
    other = shared_prefixes(docs, labelled, ngram, similarity, size)
    if deviations < math.inf:
        other = not_far(other, distinct, bits, similarity, deviations)
    more = similar(other, docs, ngram, similarity, size)
    found = common.connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = distinct.join(found, distinct.id == found.node, "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "digest").select("doc_id", "component_id")
