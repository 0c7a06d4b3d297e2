"""Token files against the tokenizers library, and what a shard must withstand."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, queries, token_files

PATH = queries.tokenizer_file("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, start string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_give_the_ids_back(kind, n):
    rng = np.random.default_rng(n)
    for most in (1, 2, 255, 49_000, 2**32):
        ids = rng.integers(0, most, n, dtype=np.uint64).astype("<u4")
        planes = token_files.to_planes(ids, kind)
        assert len(planes) == token_files.PLANES[kind]
        assert all(not p for p in planes) == (not ids.any())
        assert token_files.from_planes(planes, n, kind).tolist() == ids.tolist()


class Held(io.BytesIO):
    """Bytes as a file of pyarrow."""

    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shard_reads_any_run_of_ids(kind):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 49_000, n).astype("<u4") for n in (0, 1, 3, 64, 65, 63, 500, 0, 2)]
    sink = Held()
    writer = token_files.ShardWriter(sink, 64, kind, 3)
    for i, ids in enumerate(docs):
        writer.add(10 * i, ids)
    writer.close()
    shard, every = token_files.ShardFile(sink), np.concatenate(docs)
    assert [(d, s, i.tolist()) for d, s, i in shard.documents()] == [(10 * i, sum(map(len, docs[:i])), ids.tolist()) for i, ids in enumerate(docs)]
    assert set(shard.counts[:-1].tolist()) == {64}
    for start, stop in ((0, 0), (0, 1), (63, 65), (64, 128), (100, len(every)), (0, len(every))):
        assert shard.read(start, stop).tolist() == every[start:stop].tolist()
    with pytest.raises(ValueError):
        token_files.ShardFile(Held(sink.getvalue()[:-1]))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_documents_come_back_as_the_library_encodes(spark, tmp_path, library, monkeypatch, planes):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 3000)
    rng = random.Random(3)
    texts = ["", None, "x", " \t\n", "\x1c odd \x1d space", "Ünïcode ǅ ﬁ 🙂 \x00", "ABC abc Abc"] + [" ".join(rng.choice(["the", "Cat", "naïve", "12.5", "don't", "—"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [(3 * i - 50, t, "i", "s", "n") for i, t in enumerate(texts)]
    got = token_files.write_tokens(spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA), PATH, str(tmp_path / "t"), planes=planes, block=50)
    assert len(token_files.read_manifest(str(tmp_path / "t"))) > 1
    found = {r.doc_id: (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in got.collect()}
    at = 0
    for doc, text, *_ in sorted(rows):
        ids = library(text)
        assert found[doc] == (at, len(ids), ids)
        at += len(ids)
    crc = {r.doc_id: r.c for r in got.select("doc_id", F.crc32("ids").alias("c")).collect()}
    assert all(crc[d] == zlib.crc32(np.array(ids, "<u4").tobytes()) for d, (_, _, ids) in found.items())


def test_repeated_rows_null_ids_and_nothing(spark, tmp_path, library):
    rows = [(1, "one two", "", "", ""), (1, "one two", "", "", ""), (1, "three", "", "", ""), (None, "gone", "", "", "")]
    got = token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), PATH, str(tmp_path / "a")).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted([library("one two"), library("one two"), library("three")])
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    empty = token_files.write_tokens(spark.createDataFrame([], SCHEMA), PATH, str(tmp_path / "b"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "start", "n_tokens", "ids"]


def test_very_long_text_spans_blocks(spark, tmp_path, library):
    text = "alpha Beta gamma, " * 300_000  # 5 MB
    got = token_files.write_tokens(spark.createDataFrame([(2, text, "", "", ""), (1, "short", "", "", "")], SCHEMA), PATH, str(tmp_path / "t"))
    found = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in got.collect()}
    assert found[2].tolist() == library(text) and found[1].tolist() == library("short")


def test_commit_counts_only_what_it_names(spark, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame([(1, "a", "", "", "")], SCHEMA), PATH, folder)
    (tmp_path / "t" / "shard-lost.tok").write_bytes(b"left by a task that was lost")
    assert token_files.read_tokens(spark, folder).count() == 1
    with pytest.raises(Exception, match="holds token files already"):
        token_files.write_tokens(spark.createDataFrame([(2, "b", "", "", "")], SCHEMA), PATH, folder)
    assert [r.doc_id for r in token_files.read_tokens(spark, folder).collect()] == [1]
    ids = spark.createDataFrame([(5, bytes(4)), (6, bytes(8))], "doc_id long, ids binary").coalesce(1)
    ids.write.format(token_files.FORMAT).mode("overwrite").save(folder)
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.read_tokens(spark, folder).collect()] == [(5, 0, 1), (6, 1, 2)]
    assert len(list((tmp_path / "t").glob("shard-*"))) == 2  # the new shard, and the one that nobody named
    for bad in ([(6, bytes(4)), (5, bytes(4))],):
        with pytest.raises(Exception, match="ascending"):
            spark.createDataFrame(bad, "doc_id long, ids binary").coalesce(1).write.format(token_files.FORMAT).mode("append").save(str(tmp_path / "u"))
    assert not list((tmp_path / "u").glob("shard-*"))
    mixed = spark.range(0, 4, 1, 2).selectExpr("id % 2 * 8 + 1 AS doc_id", "CAST('abcd' AS BINARY) AS ids")  # two tasks, 1 and 9 each
    with pytest.raises(Exception, match="overlap"):
        mixed.write.format(token_files.FORMAT).mode("append").save(str(tmp_path / "v"))
    assert not list((tmp_path / "v").glob("shard-*"))
