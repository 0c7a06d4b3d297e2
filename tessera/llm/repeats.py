"""Repeated windows of a corpus: the passes that suffix-array and substring de-duplication share.

A window is `window` consecutive units (bytes or words) of one document. It is covered if the same window starts
earlier: in a smaller doc_id, or, if the settings say so, at an earlier start in the same document. The passes move
minimiser seeds (about 2 / (window - gram + 2) of all places), never whole texts against each other:

1. seeds       every window picks a gram by its content alone, so equal windows meet under equal keys;
2. classify    seeds of one key meet in one bucket. Seeds with the same whole context are a class: its earliest seed
               stands for it and keeps the list of the others' places. Keys with one seed only are done;
3. contexts    the texts of the classes that share something are cut out by a co-grouping on document buckets;
4. resolve     the operator (an enhanced suffix array, or seed extension) finds every repeat among those contexts;
5. apply       the spans found meet their document, and the caller's function makes its row.

Buckets hold about BUCKET_BYTES of text at any scale. Equal contexts of one flush are folded before they are sent on,
so a passage that a third of all documents share sends one seed for each flush, not for each document. A key that very
many different contexts share is split by content (textkit.split_seeds()) first by the half before or behind the gram, then,
if need be, by whole windows; which keys these are is estimated on a sample and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, textkit

#: Text for each bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 24_000_000, 96
#: Seeds that a task gathers before it sends them to their buckets.
FLUSH = 300_000
#: Documents that hot keys are estimated on, different contexts that make a key hot, and how many of them the sample must show.
SAMPLE, HOT, SHOWN = 2000, 20_000, 3
#: Bytes of a word beyond which it is compared by a digest.
LONG_WORD = 64
BLOBS = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("payload", pa.binary())])
BLOBS_DDL = "kind tinyint, bucket int, payload binary"


@dataclass(frozen=True)
class Settings:
    unit: str  # "byte" or "word"
    window: int
    gram: int
    within: bool  # whether an earlier start in the same document counts
    tree: bool  # whether classes of equal contexts go to the operator too

    @property
    def byte(self) -> bool:
        return self.unit == "byte"


def units(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit values, each text's first unit and the one after its last."""
    if s.byte:
        return textkit.joined(texts)
    counts = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))
    ends = np.cumsum(counts)
    return textkit.word_hashes(texts), ends - counts, ends


def seeds_of(texts: list[bytes], s: Settings, hot: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Seeds of the texts, those of hot keys (by level, ascending) split."""
    values, lo, hi = units(texts, s)
    c, slices = textkit.seeds(values, s.byte, lo, hi, s.window, s.gram, not s.byte)
    for level, keys in enumerate(hot, 1):
        if len(keys) and len(c["key"]):
            at = keys[np.minimum(np.searchsorted(keys, c["key"]), len(keys) - 1)] == c["key"]
            if at.any():
                parts = textkit.split_seeds({k: v[at] for k, v in c.items()}, slices, lo, s.window, s.gram, level, not s.byte)
                c = {k: np.r_[v[~at], parts[k]] for k, v in c.items()}
    return c


def hot_keys(docs: DataFrame, s: Settings, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of either level that HOT or more different contexts are expected to share, from whole texts of about SAMPLE documents.

    At most one key for every SHOWN seeds of the sample comes to the driver, whatever the corpus.
    """
    none = np.zeros(0, np.uint64)
    if size < HOT * s.window:
        return none, none
    every = max(1, rows // SAMPLE)

    @common.tidy_rows
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for _, texts in common.chunks(*common.text_list(batch)):
                values, lo, hi = units(texts, s)
                c, slices = textkit.seeds(values, s.byte, lo, hi, s.window, s.gram)
                for level in (1, 2):
                    yield pa.record_batch([pa.array(np.full(len(c["key"]), level), pa.int32()), pa.array(c["key"].view(np.int64)), pa.array(c["context"].view(np.int64))], names=["level", "key", "context"])
                    c = textkit.split_seeds(c, slices, lo, s.window, s.gram, level, False) if level == 1 else c

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(run, "level int, key long, context long")
    counted = sampled.groupBy("level", "key").agg(F.count_distinct("context").alias("n"))
    found = counted.where((F.col("n") >= SHOWN) & (F.col("n") * every >= HOT)).select("level", "key").collect()
    return tuple(np.sort(np.array([r["key"] for r in found if r["level"] == level], np.int64).view(np.uint64)) for level in (1, 2))


def bucket_of(values: np.ndarray, n: int) -> np.ndarray:
    return (textkit.mix(values.astype(np.uint64) ^ np.uint64(0x5DEECE66D)) % np.uint64(n)).astype(np.int32)


def blobs(kind: int, buckets: np.ndarray, columns: dict[str, np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One payload for each bucket that has rows."""
    if not len(buckets):
        return []
    order = np.argsort(buckets, kind="stable")
    sorted_buckets, columns = buckets[order], {k: v[order] for k, v in columns.items()}
    return [(kind, int(sorted_buckets[a]), common.pack(**{k: v[a:b] for k, v in columns.items()})) for a, b in zip(*common.runs_of(sorted_buckets), strict=True)]


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, buckets, payloads = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.record_batch([pa.array(kinds, pa.int8()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], schema=BLOBS)


def classes(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by class and place, and where a class starts in it: equal key, whole context and windows that it stands for."""
    sides = (c["before"].astype(np.uint64) << np.uint64(48)) | (c["after"].astype(np.uint64) << np.uint64(32))
    windows = textkit.mix(sides | c["left"].astype(np.uint64)) + c["right"].astype(np.uint64)
    columns = [c["key"], c["context"], *([c["context2"]] if "context2" in c else []), windows]
    order = np.lexsort((c["at"], c["doc"], *columns[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in columns]) if len(order) else new[1:]
    return order, new


def covered_by(c: dict[str, np.ndarray], first: np.ndarray, within: bool) -> np.ndarray:
    """Whether a seed's windows stand earlier, at the first of its class; a repeated row's seeds stand at the same place."""
    if within:
        return (c["doc"] != c["doc"][first]) | (c["at"] != c["at"][first])
    return c["doc"] > c["doc"][first]


def fold(c: dict[str, np.ndarray], within: bool) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Seeds of one flush without those that an earlier one of their class covers, and these as places (of, doc, at) of it."""
    order, new = classes(c)
    c = {k: v[order] for k, v in c.items()}
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    covered = covered_by(c, first, within)
    of = (np.cumsum(~covered) - 1)[first[covered]]
    return {k: v[~covered] for k, v in c.items()}, {"of": of.astype(np.int32), "doc": c["doc"][covered], "at": c["at"][covered]}


def seed_blobs(c: dict[str, np.ndarray], copies: dict[str, np.ndarray], n: int) -> list[tuple[int, int, bytes]]:
    """One payload for each bucket: its seeds, and the places folded into them."""
    buckets = bucket_of(c["key"], n)
    order = np.argsort(buckets, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = place[copies["of"]]
    by = np.argsort(of, kind="stable")
    of, doc, at = of[by], copies["doc"][by], copies["at"][by]
    out = []
    for a, b in zip(*common.runs_of(buckets[order]), strict=True):
        lo, hi = np.searchsorted(of, [a, b])
        head = common.pack(**{k: v[order[a:b]] for k, v in c.items()})
        out.append((0, int(buckets[order[a]]), common.two(head, common.pack(of=(of[lo:hi] - a).astype(np.int32), doc=doc[lo:hi], at=at[lo:hi]))))
    return out


def unfold(payloads: list[bytes]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All seeds of seed_blobs() and the places folded into them."""
    parts = [common.split_two(p) for p in payloads]
    seeds, copies = [common.unpack(a) for a, _ in parts], [common.unpack(b) for _, b in parts]
    ahead = np.cumsum([0, *(len(x["key"]) for x in seeds)])
    moved = [{**x, "of": x["of"] + a} for x, a in zip(copies, ahead.tolist(), strict=False)]
    return common.concat(seeds), common.concat(moved)


def spread(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each row's group has two different values."""
    if not len(group):
        return np.zeros(0, bool)
    order = np.argsort(group, kind="stable")
    starts, _ = common.runs_of(group[order])
    return (np.minimum.reduceat(values[order], starts) != np.maximum.reduceat(values[order], starts))[group]


def classify(c: dict[str, np.ndarray], copies: dict[str, np.ndarray], within: bool, tree: bool):
    """Places of classes behind their first seed, and the seeds whose contexts must be compared.

    Of a class the first seed stands for all. It is asked for if another class of the key shares a side with it, and, if
    `tree`, also if it has copies (lone: with nothing else to compare).
    """
    _, inverse, count = np.unique(c["key"], return_inverse=True, return_counts=True)
    folded = np.bincount(copies["of"], minlength=len(c["key"])) > 0
    keep = (count[inverse] > 1) | folded
    at = (np.cumsum(keep) - 1)[copies["of"]]
    c = {k: v[keep] for k, v in c.items()}
    order, new = classes(c)
    c = {k: v[order] for k, v in c.items()}
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = place[at]
    number = np.cumsum(new) - 1
    first = np.flatnonzero(new)[number] if len(new) else number
    covered = covered_by(c, first, within)
    several = np.zeros(len(order), bool)
    for side in ("before", "after"):  # another class, and another document if need be, that shares this side
        held = np.flatnonzero(c[side])
        _, group = np.unique(textkit.mix(c["key"][held] ^ (c[side][held].astype(np.uint64) << np.uint64(40))), return_inverse=True)
        several[held] |= spread(group, number[held]) if within else spread(group, number[held]) & spread(group, c["doc"][held])
    rows = np.r_[np.flatnonzero(covered), of]
    behind = {"class": number[rows].astype(np.int32), "doc": np.r_[c["doc"][covered], copies["doc"]], "at": np.r_[c["at"][covered], copies["at"]], "left": c["left"][rows], "right": c["right"][rows]}
    copied = new & (np.bincount(behind["class"], minlength=len(order))[number] > 0) if tree else np.zeros(len(order), bool)
    ask = ~covered & (several | copied)
    asked = {k: c[k][ask] for k in ("doc", "at", "left", "right", "key")} | {"class": number[ask].astype(np.int32), "copied": copied[ask], "lone": ~several[ask]}
    return behind, asked


def whole_spans(c: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """The spans of whole contexts."""
    at = c["at"].astype(np.int64)
    return {"doc": c["doc"], "start": (at - c["left"]).astype(np.uint32), "end": (at - c["right"] + window).astype(np.uint32)}


def compared_word(word: bytes) -> bytes:
    """A word as it is compared: long ones by a 256-bit digest, so that a context stays small."""
    return word if len(word) <= LONG_WORD else b"\0" + hashlib.blake2b(word, digest_size=32).hexdigest().encode()


#: What finds the repeats among a bucket's contexts: asked seeds, their texts and the settings to spans, and the classes whose copies are covered.
Resolve = Callable[[dict[str, np.ndarray], list[bytes], Settings], tuple[dict[str, np.ndarray], np.ndarray]]


def spans_of_repeats(docs: DataFrame, s: Settings, resolve: Resolve) -> tuple[DataFrame, DataFrame, int]:
    """Blobs of texts and blobs of covered spans (doc, start, end in units) by document bucket, and the bucket count."""
    if not 0 < s.gram <= s.window:
        raise ValueError(f"a gram of {s.gram} does not fit a window of {s.window}")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    rows, size = common.rows_and_bytes(docs)
    n = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    hot = hot_keys(docs, s, rows, size)

    @common.tidy_rows
    def find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in common.slices(batches):
            for ids, texts in common.chunks(*common.text_list(batch)):
                found = seeds_of(texts, s, hot)
                if len(found["key"]):
                    held.append({"doc": ids[found.pop("piece")], **found})
                    size += len(found["key"])
                if size >= FLUSH:
                    yield as_batch(seed_blobs(*fold(common.concat(held), s.within), n))
                    held, size = [], 0
        if held:
            yield as_batch(seed_blobs(*fold(common.concat(held), s.within), n))

    @common.tidy_group
    def classify_bucket(table: pa.Table) -> pa.Table:
        behind, asked = classify(*unfold(table.column("payload").to_pylist()), s.within, s.tree)
        rows = blobs(2, bucket_of(asked["doc"], n), asked)
        if s.tree:
            rows += [(4, table.column("bucket")[0].as_py(), common.pack(**behind))] if len(behind["doc"]) else []
        else:
            spans = whole_spans(behind, s.window)
            rows += blobs(1, bucket_of(spans["doc"], n), spans)
        return pa.Table.from_batches([as_batch(rows)])

    @common.tidy_rows
    def text_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = common.text_list(batch)
            buckets = bucket_of(ids, n)
            order = np.argsort(buckets, kind="stable")
            rows = []
            for a, b in zip(*common.runs_of(buckets[order]), strict=True):
                rows.append((0, int(buckets[order[a]]), common.pack_texts(ids[order[a:b]], [texts[i] for i in order[a:b].tolist()])))
            yield as_batch(rows)

    @common.tidy_group
    def cut_contexts(texts: pa.Table, asked: pa.Table) -> pa.Table:
        c = common.unpack_all(asked.column("payload").to_pylist())
        rows = []
        if c:
            order = np.argsort(c["doc"], kind="stable")
            c = {k: v[order] for k, v in c.items()}
            pieces, places = [], []
            for payload in texts.column("payload").to_pylist():
                ids, held = common.unpack_texts(payload)
                lo, hi = np.searchsorted(c["doc"], ids, "left"), np.searchsorted(c["doc"], ids, "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    asked_of = slice(lo[i], hi[i])
                    start = c["at"][asked_of].astype(np.int64) - c["left"][asked_of]
                    end = c["at"][asked_of].astype(np.int64) - c["right"][asked_of] + s.window
                    text = held[i] if s.byte else list(map(compared_word, held[i].split()))
                    inside = end <= len(text)  # all, unless two texts share a doc_id
                    cut = [text[a:b] for a, b in zip(start[inside].tolist(), end[inside].tolist(), strict=True)]
                    pieces += cut if s.byte else map(b" ".join, cut)
                    places.append(np.arange(lo[i], hi[i])[inside])
            if places:
                at = np.concatenate(places)
                rows = context_blobs({k: v[at] for k, v in c.items()}, pieces, n)
        return pa.Table.from_batches([as_batch(rows)])

    @common.tidy_group
    def resolve_bucket(contexts: pa.Table, copies: pa.Table) -> pa.Table:
        parts = [unpack_contexts(p) for p in contexts.column("payload").to_pylist()]
        if not parts:
            return pa.Table.from_batches([as_batch([])])
        c = common.concat([p[0] for p in parts])
        spans, whole = resolve(c, [t for p in parts for t in p[1]], s)
        behind = common.unpack_all(copies.column("payload").to_pylist())
        if behind:
            held = np.isin(behind["class"], whole)
            spans = common.concat([spans, whole_spans({k: v[held] for k, v in behind.items()}, s.window)])
        return pa.Table.from_batches([as_batch(blobs(1, bucket_of(spans["doc"], n), spans))])

    found = docs.mapInArrow(find_seeds, BLOBS_DDL).groupBy("bucket").applyInArrow(classify_bucket, BLOBS_DDL)
    found = common.checkpoint(found)
    texts = docs.mapInArrow(text_blobs, BLOBS_DDL)
    contexts = texts.groupBy("bucket").cogroup(found.where("kind = 2").groupBy("bucket")).applyInArrow(cut_contexts, BLOBS_DDL)
    more = contexts.groupBy("bucket").cogroup(found.where("kind = 4").groupBy("bucket")).applyInArrow(resolve_bucket, BLOBS_DDL)
    return texts, found.where("kind = 1").unionByName(more), n


def context_blobs(c: dict[str, np.ndarray], pieces: list[bytes], n: int) -> list[tuple[int, int, bytes]]:
    buckets = bucket_of(c["key"], n)
    order = np.argsort(buckets, kind="stable")
    out = []
    for a, b in zip(*common.runs_of(buckets[order]), strict=True):
        head = common.pack(**{k: v[order[a:b]] for k, v in c.items()})
        body = common.pack_texts(c["doc"][order[a:b]], [pieces[i] for i in order[a:b].tolist()])
        out.append((3, int(buckets[order[a]]), common.two(head, body)))
    return out


def unpack_contexts(payload: bytes) -> tuple[dict[str, np.ndarray], list[bytes]]:
    head, body = common.split_two(payload)
    return common.unpack(head), common.unpack_texts(body)[1]


def union_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans of each document; touching spans are one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, start, end
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    shift = (np.cumsum(new_doc) - 1) * (1 << 33)
    reach = np.maximum.accumulate(end + shift)
    new = new_doc | np.r_[True, (start + shift)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], reach[last] - shift[last]


def apply_spans(texts: DataFrame, spans: DataFrame, row: Callable[[int, bytes, np.ndarray, np.ndarray], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """row(doc_id, text, starts, ends) of every document with the maximal runs of its spans."""

    @common.tidy_group
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        c = common.unpack_all(right.column("payload").to_pylist())
        doc, start, end = union_spans(c["doc"], c["start"], c["end"]) if c else (np.zeros(0, np.int64),) * 3
        out = []
        for payload in left.column("payload").to_pylist():
            ids, held = common.unpack_texts(payload)
            lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            out += [row(int(d), t, start[a:b], end[a:b]) for d, t, a, b in zip(ids.tolist(), held, lo.tolist(), hi.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        return pa.table([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(finish, ddl)
