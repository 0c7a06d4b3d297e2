"""Token files: ids of documents in fixed-size blocks, each transposed to bit or byte planes and compressed plane by plane.

A folder holds shards and `_manifest.json`, which is put in place last and alone says which shards count. A shard is

    MAGIC, then the compressed planes of all blocks one after another,
    a footer (zstandard: a JSON line, then the chunk index and the document index as little-endian arrays),
    the footer's length (8 bytes, little-endian), MAGIC.

The chunk index holds, for each block, its count of ids and the compressed length of each plane (0: all its bits are zero); the
document index holds doc_id and count of ids. Where each id stands follows from these by addition, so that one document can be
read without the rest of its shard.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.llm import common, packing

#: Name of the format, first and last bytes of a shard, the file that makes a folder valid.
FORMAT, MAGIC, MANIFEST = "token_planes", b"TKPLANE1", "_manifest.json"
#: Ids of a block, text bytes for each shard, most shards (beyond, shards grow), rows and ids of a batch read back.
BLOCK, SHARD_BYTES, MOST_SHARDS, READ_ROWS, READ_IDS = 65_536, 16_000_000, 20_000, 1000, 4_000_000
PLANES = {"byte": 4, "bit": 32}
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids (unsigned, 32 bits), lowest first; an all-zero plane is empty."""
    data = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = data.T if kind == "byte" else np.packbits(np.unpackbits(data, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of to_planes()."""
    width = n if kind == "byte" else -(-n // 8)
    data = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    data = data.T if kind == "byte" else np.packbits(np.unpackbits(data, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
    return np.ascontiguousarray(data).view("<u4").ravel()


class ShardWriter:
    """Writes blocks as documents come; holds one block of ids and the indices."""

    def __init__(self, sink, block: int, kind: str, level: int):
        self.sink, self.block, self.kind, self.pack = sink, block, kind, zstandard.ZstdCompressor(level=level)
        self.pending, self.waiting = [], 0
        self.counts, self.lengths, self.docs, self.sizes = [], [], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            held = np.concatenate(self.pending)
            whole = len(held) // self.block * self.block
            for at in range(0, whole, self.block):
                self.flush(held[at : at + self.block])
            self.pending, self.waiting = [held[whole:].copy()], len(held) - whole

    def flush(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.sink.write(b"".join(planes))
        self.counts.append(len(ids))
        self.lengths.append([len(p) for p in planes])

    def close(self) -> None:
        if self.waiting:
            self.flush(np.concatenate(self.pending))
        head = {"block": self.block, "planes": self.kind, "blocks": len(self.counts), "docs": len(self.docs)}
        arrays = [np.array(self.counts, "<i8"), np.array(self.lengths, "<i8").ravel(), np.array(self.docs, "<i8"), np.array(self.sizes, "<i8")]
        footer = self.pack.compress(json.dumps(head).encode() + b"\n" + b"".join(a.tobytes() for a in arrays))
        self.sink.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class ShardFile:
    """A shard opened for reading: its indices, and any run of blocks."""

    def __init__(self, source):
        self.source = source
        end = source.size() - len(MAGIC) - 8
        tail = source.read_at(len(MAGIC) + 8, end) if end > 0 else b""
        if end <= 0 or tail[8:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("this is no whole token shard")
        size = int.from_bytes(tail[:8], "little")
        data = zstandard.ZstdDecompressor().decompress(source.read_at(size, end - size))
        at = data.index(b"\n") + 1
        head = json.loads(data[:at])
        self.kind, blocks, docs = head["planes"], head["blocks"], head["docs"]
        planes = PLANES[self.kind]
        numbers = np.frombuffer(data, "<i8", offset=at)
        self.counts, self.lengths, self.docs, self.sizes = np.split(numbers, np.cumsum([blocks, blocks * planes, docs]))
        self.lengths = self.lengths.reshape(blocks, planes)
        self.at = len(MAGIC) + np.r_[0, np.cumsum(self.lengths.sum(axis=1))]
        self.first = np.r_[0, np.cumsum(self.counts)]

    def ids(self, block: int) -> np.ndarray:
        data, unpack = self.source.read_at(int(self.at[block + 1] - self.at[block]), int(self.at[block])), zstandard.ZstdDecompressor()
        edges = np.r_[0, np.cumsum(self.lengths[block])].tolist()
        return from_planes([unpack.decompress(data[s:e]) if e > s else b"" for s, e in zip(edges, edges[1:], strict=False)], int(self.counts[block]), self.kind)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start ... stop - 1 of the shard; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = (int(np.searchsorted(self.first, x, "right")) - 1 for x in (start, stop - 1))
        return np.concatenate([self.ids(b) for b in range(first, last + 1)])[start - self.first[first] : stop - self.first[first]]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, start in the shard and ids of each document, in order; a block is read once."""
        held, base, block, at = np.zeros(0, "<u4"), 0, 0, 0
        for doc, size in zip(self.docs.tolist(), self.sizes.tolist(), strict=True):
            more = []
            have = base + len(held)
            while have < at + size:
                more.append(self.ids(block))
                have += len(more[-1])
                block += 1
            if more:
                held, base = np.concatenate([held[at - base :], *more]), at
            yield doc, at, held[at - base : at - base + size]
            at += size


@dataclass
class Written(WriterCommitMessage):
    """What a task has written."""

    file: str
    first: int | None
    last: int | None
    docs: int
    ids: int


@dataclass
class Shard(InputPartition):
    """A shard of the manifest, and the ids before it."""

    file: str
    start: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class TokenWriter(DataSourceArrowWriter):
    """Each task writes one shard under a name of its own; the commit orders the shards of the tasks that counted."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.tokenizer = options["path"], overwrite, options.get("tokenizer")
        self.block, self.kind, self.level = int(options.get("block", BLOCK)), options.get("planes", "byte"), int(options.get("level", 3))
        if self.kind not in PLANES or self.block < 1:
            raise ValueError("planes is byte or bit, block a positive number of ids")

    def documents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """doc_id and ids of each row."""
        if not self.tokenizer:
            for batch in iterator:
                for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    yield doc, np.frombuffer(data.as_buffer() or b"", "<u4")
            return
        words, end = packing.encoder(self.tokenizer), np.array([packing.END], "<u4")
        for batch in common.slices(iterator):
            for docs, texts in common.chunks(batch.column("doc_id").to_numpy(), [t or "" for t in batch.column("text").to_pylist()], packing.TOGETHER):
                for doc, ids in zip(docs.tolist(), words.encode_batch(texts), strict=True):
                    yield doc, np.concatenate([ids, end])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = opened(self.path)
        shard, name = None, f"shard-{uuid.uuid4().hex}.tok"
        first = last = None
        docs = ids = 0
        try:
            for doc, values in self.documents(iterator):
                if shard is None:
                    store.create_dir(folder, recursive=True)
                    first, shard = doc, ShardWriter(store.open_output_stream(f"{folder}/{name}"), self.block, self.kind, self.level)
                elif doc < last:
                    raise ValueError("documents of a shard must come in ascending doc_id order")
                shard.add(doc, values)
                last, docs, ids = doc, docs + 1, ids + len(values)
            if shard is not None:
                shard.close()
                shard.sink.close()
        except BaseException:
            if shard is not None:
                shard.sink.close()
                store.delete_file(f"{folder}/{name}")
            raise
        return Written(name, first, last, docs, ids)  # no documents: no file

    def commit(self, messages: list[Written | None]) -> None:
        """One line for each shard reaches the driver (MOST_SHARDS at most in write_tokens())."""
        store, folder = opened(self.path)
        done = sorted((m for m in messages if m is not None and m.docs), key=lambda m: (m.first, m.last))
        if any(a.last > b.first for a, b in zip(done, done[1:], strict=False)):
            self.abort(messages)
            raise ValueError("shards overlap: part the rows by ranges of doc_id first")
        before = []
        if store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ValueError("the folder holds token files already")
            before = [s["file"] for s in read_manifest(self.path)]
        store.create_dir(folder, recursive=True)
        name = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(name) as f:
            f.write(json.dumps({"format": FORMAT, "version": 1, "shards": [m.__dict__ for m in done]}).encode())
        store.move(name, f"{folder}/{MANIFEST}")
        for file in before:
            store.delete_file(f"{folder}/{file}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for m in messages:
            if m is not None and m.docs:
                store.delete_file(f"{folder}/{m.file}")


def read_manifest(path: str) -> list[dict]:
    store, folder = opened(path)
    with store.open_input_file(f"{folder}/{MANIFEST}") as f:
        held = json.loads(f.read())
    if held.get("format") != FORMAT or held.get("version") != 1:
        raise ValueError("the manifest is of another format or version")
    return held["shards"]


class TokenReader(DataSourceReader):
    """A task for each shard; blocks are read one after another."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        out, start = [], 0
        for s in read_manifest(self.path):
            out.append(Shard(s["file"], start))
            start += s["ids"]
        return out or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = opened(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as source:
            rows, held = [], 0
            for doc, start, ids in ShardFile(source).documents():
                rows.append((doc, partition.start + start, len(ids), ids.tobytes()))
                held += len(ids)
                if len(rows) >= READ_ROWS or held >= READ_IDS:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)
        common.release()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """The format `token_planes`: write (doc_id long, ids binary) in ascending doc_id order, read SCHEMA.

    Options of a write: `block` (ids of a block), `planes` (byte or bit), `level` (of zstandard), and `tokenizer`, a vocabulary
    file: then (doc_id long, text string) is written, each text encoded and ended by END.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options, overwrite)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, planes: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encodes docs (doc_id, text), writes them to `folder` in ascending doc_id order, and returns read_tokens(folder).

    Null texts are empty, an empty text is the end mark alone. Rows without a doc_id are left out; a repeated row is written
    again, different texts of one doc_id in the order of their hashes; other columns are ignored; an empty table gives a folder
    without shards. doc_id is a whole number. Texts are parted by ranges of doc_id once, then encoded and written by the
    same task; a task that is run again writes another file, and only files in the manifest count.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    _, size = common.rows_and_bytes(docs)
    shards = int(min(MOST_SHARDS, max(1, size // SHARD_BYTES)))
    docs = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    docs.write.format(FORMAT).options(tokenizer=tokenizer, block=block, planes=planes).mode("append").save(folder)
    return read_tokens(spark, folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """SCHEMA: each document of the folder, the ids of all documents before it, its ids (little-endian, 32 bits)."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of checkpoints."""
    common.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
