"""Commits of the table store: whole or nothing, for readers, for a second writer, and where a writer dies."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import store
from tessera.streaming import incremental

CHUNK = store.TABLES["code_chunks"]


def chunks(spark, *rows):
    return spark.createDataFrame([(i, f, 1, 2, "c", str(i)) for i, f in rows], CHUNK)


def ids(s, name="code_chunks", version=None):
    return sorted(r.id for r in s.read(name, version).collect())


def vectors(spark, *held):
    return spark.createDataFrame([(i, [float(i)]) for i in held], store.TABLES["code_embeddings"])


@pytest.mark.parametrize("name,content", [("state.json", '{"theme": "dark"}'), ("store.json", '{"version": 1}'), ("store.json", "no json"), ("mine.txt", "x")])
def test_foreign_folders_are_refused_and_not_touched(spark, tmp_path, name, content):
    (tmp_path / "deep").mkdir()
    for path in (name, "deep/other.txt"):
        (tmp_path / path).write_text(content)
    with pytest.raises(ValueError, match="no store"):
        store.Store(spark, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*")) == sorted([name, "deep", "deep/other.txt"]) and (tmp_path / name).read_text() == content


def test_another_layout_loses_only_what_it_lists(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("code_chunks", chunks(spark, (1, 1)))
    (tmp_path / "s" / "notes.txt").write_text("mine")
    (tmp_path / "s" / "code_chunks" / "mine").mkdir()
    marker = json.loads((tmp_path / "s" / store.MARKER).read_text())
    (tmp_path / "s" / store.MARKER).unlink()
    (tmp_path / "s" / f".{store.MARKER}.crc").unlink(missing_ok=True)
    (tmp_path / "s" / store.MARKER).write_text(json.dumps(marker | {"version": 1}))
    again = store.Store(spark, str(tmp_path / "s"), buckets=4)
    assert again.version() == 0 and again.buckets == 4 and ids(again) == []
    assert (tmp_path / "s" / "notes.txt").exists() and (tmp_path / "s" / "code_chunks" / "mine").exists()
    assert not list((tmp_path / "s").rglob("*.parquet"))


def test_buckets_are_a_setting_of_the_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=3)
    s.append("code_chunks", chunks(spark, *((i, i) for i in range(40))))
    assert set(s.parts()["code_chunks"]) == {"0", "1", "2"}
    assert store.Store(spark, str(tmp_path), buckets=64).buckets == 3 and ids(store.Store(spark, str(tmp_path))) == list(range(40))


def test_several_tables_in_one_commit_and_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    with s.transaction() as t:
        t.append("code_chunks", chunks(spark, (1, 1), (2, 2)))
        t.append("code_embeddings", vectors(spark, 1, 2))
        assert sorted(r.id for r in t.read("code_chunks").collect()) == [1, 2]  # its own changes
        assert ids(s) == []  # nobody else's yet
    first, lazy = s.version(), s.read("code_chunks")
    assert first == 1 and ids(s, "code_embeddings") == [1, 2]
    s.delete_chunks(spark.createDataFrame([(1,)], "file_id long"))
    assert s.version() == 2 and ids(s) == ids(s, "code_embeddings") == [2]
    assert ids(s, version=first) == ids(s, "code_embeddings", first) == [1, 2]
    s.append("code_chunks", chunks(spark, (5, 5)))
    assert sorted(r.id for r in lazy.collect()) == [1, 2]
    for i in range(store.KEPT_VERSIONS):
        s.append("code_chunks", chunks(spark, (10 + i, 9)))
    assert len(s.versions()) == store.KEPT_VERSIONS
    with pytest.raises(ValueError, match="not kept"):
        s.read("code_chunks", first)


def tables(s):
    return {name: ids(s, name) for name in ("code_chunks", "code_embeddings")}


@pytest.mark.parametrize("dies_at", ["first write", "second write", "draft", "link"])
def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch, dies_at):
    s = store.Store(spark, str(tmp_path))
    with s.transaction() as t:
        t.append("code_chunks", chunks(spark, (1, 1)))
        t.append("code_embeddings", vectors(spark, 1))
    before, writes = tables(s), []

    class Killed(BaseException):
        pass

    with monkeypatch.context() as m:
        if dies_at in ("first write", "second write"):
            real = store.Transaction._write

            def write(self, *args):
                real(self, *args)
                writes.append(1)
                if len(writes) == (1 if dies_at == "first write" else 2):
                    raise Killed

            m.setattr(store.Transaction, "_write", write)
        elif dies_at == "link":

            def link(*_):
                raise Killed

            m.setattr(store.os, "link", link)
        else:
            real_put = store.Folder.put_new

            def put(self, path, content):
                if path.startswith(store.COMMITS):
                    (tmp_path / store.COMMITS / "half.draft").write_text('{"format": "tess')
                    raise Killed
                return real_put(self, path, content)

            m.setattr(store.Folder, "put_new", put)
        with pytest.raises(Killed):
            with s.transaction() as t:
                t.delete("code_embeddings", spark.createDataFrame([(1,)], "id long"))
                t.replace("code_chunks", spark.createDataFrame([(1,)], "file_id long"), chunks(spark, (7, 1)))
    again = store.Store(spark, str(tmp_path))
    assert again.version() == 1 and tables(again) == before
    again.append("code_chunks", chunks(spark, (3, 3)))
    assert tables(again)["code_chunks"] == [1, 3]
    assert again.vacuum() == 0 and again.vacuum(older_than=0) >= 1  # what the dead writer left
    assert tables(again)["code_chunks"] == [1, 3]


def test_two_writers(spark, tmp_path):
    s, other = store.Store(spark, str(tmp_path), buckets=8), store.Store(spark, str(tmp_path))
    s.append("code_chunks", chunks(spark, *((i, i) for i in range(8))))
    a, b = s.transaction(), other.transaction()
    a.replace("code_chunks", spark.createDataFrame([(1,)], "file_id long"), chunks(spark, (101, 1)))
    b.replace("code_chunks", spark.createDataFrame([(1,)], "file_id long"), chunks(spark, (201, 1)))
    a.commit()
    with pytest.raises(store.Conflict, match="code_chunks"):
        b.commit()
    assert ids(s) == [0, 2, 3, 4, 5, 6, 7, 101]
    bucket = {r.file_id: str(r.b) for r in s.read("code_chunks").select("file_id", s.bucket("code_chunks").alias("b")).collect()}
    far = next(f for f in range(8) if bucket[f] != bucket[2])
    a, b, c = s.transaction(), other.transaction(), s.transaction()
    a.delete("code_chunks", spark.createDataFrame([(2,)], "file_id long"))
    b.delete("code_chunks", spark.createDataFrame([(far,)], "file_id long"))  # another bucket
    c.append("code_chunks", chunks(spark, (302, 2), (303, 3)))  # rests on no bucket
    assert [a.commit(), b.commit(), c.commit()] == [3, 4, 5]
    left = sorted({0, 3, 4, 5, 6, 7, 101, 302, 303} - {far if far != 1 else 101})
    assert ids(s) == ids(other) == left


def test_point_reads_open_one_bucket(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=8)
    paths = spark.createDataFrame([(f"p{i}",) for i in range(50)], "path string")
    s.append("files", paths.select(store.key_id("path").alias("id"), "path", F.lit("h").alias("hash"), F.lit("python").alias("language"), F.current_timestamp().alias("indexed_at")))
    s.append("symbols", spark.createDataFrame([(100 + i, i % 10, f"s{i}", "function", i, i, "") for i in range(200)], store.TABLES["symbols"]))
    one = s.find_all("symbols", [{"file_id": 3}])
    assert len({f.split("bucket=")[1][0] for f in one.inputFiles()}) == 1 and one.count() == 20
    batch = s.find_all("symbols", [{"file_id": 3, "name": "s13"}, {"file_id": 4, "name": "s13"}, {"file_id": 5, "name": "s5"}])
    assert sorted(r.id for r in batch.collect()) == [105, 113]
    assert sorted(r.id for r in s.find_all("symbols", spark.createDataFrame([(3, "s13"), (3, "s13"), (9, "no")], "file_id int, name string")).collect()) == [113]
    assert s.find_all("symbols", []).count() == 0 and s.find("symbols", id=150)["name"] == "s50" and s.find("symbols", id=-1) is None
    assert s.find("files", path="p7")["path"] == "p7" and s.find("files", path="none") is None
    s.append("files", spark.createDataFrame([(5, "odd", "h", "x", None)], store.TABLES["files"]))
    assert s.find("files", path="odd")["id"] == 5  # an id that is not made from its path
    with pytest.raises(ValueError, match="DataFrame"):
        s.find_all("symbols", [{"file_id": 1}] * (store.MOST_LITERALS + 1))
    meta = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(s.read("symbols").inputFiles()[0]), spark._jsc.hadoopConfiguration()))
    columns = meta.getFooter().getBlocks().get(0).getColumns()
    bloom = {columns.get(i).getPath().toDotString(): columns.get(i).getBloomFilterOffset() > 0 for i in range(columns.size())}
    meta.close()
    assert bloom["id"] and bloom["name"] and not bloom["signature"]


def test_chunk_upkeep_by_deltas(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), buckets=8)
    keep = incremental.keep_chunks(s)
    files = lambda *rows: spark.createDataFrame(rows, "file_id long, content string")
    keep(files(*((i, f"text {i}\n") for i in range(8))), 0)
    held = {r.file_id: r.id for r in s.read("code_chunks").collect()}
    assert set(held) == set(range(8))
    s.append("code_embeddings", vectors(spark, *held.values()))
    before, version = s.parts()["code_chunks"], s.version()
    keep(files((1, "text 1\n"), (2, "other\n"), (3, None), (2, "an earlier other\n"), (None, "x")), 1)
    now = s.parts()["code_chunks"]
    changed = {str(r.b) for r in spark.createDataFrame([(2,), (3,)], "file_id long").select(s.bucket("code_chunks").alias("b")).collect()}
    assert {b for b in {*before, *now} if before.get(b) != now.get(b)} == changed  # file 1 is as it was
    rows = {r.file_id: r for r in s.read("code_chunks").collect()}
    assert set(rows) == set(range(8)) - {3} and rows[2].content == "other" and rows[1].id == held[1]
    assert ids(s, "code_embeddings") == sorted(set(held.values()) - {held[2], held[3]})
    assert s.version() == version + 1  # one commit
    keep(files((5, "played again\n")), 1)
    assert s.version() == version + 1
    incremental.keep_chunks(s, "second")(files((9, "x")), 0)
    assert s.version() == version + 2 and len(s.read("batches").collect()) == 2


def test_chunk_upkeep_as_a_stream(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    for day, rows in enumerate(['{"file_id": 1, "content": "a"}\n{"file_id": 2, "content": "b"}\n', '{"file_id": 2, "content": "c"}\n']):
        (tmp_path / "in" / f"{day}.json").write_text(rows)
        stream = spark.readStream.schema("file_id long, content string").json(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(incremental.keep_chunks(s)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r.file_id, r.content) for r in s.read("code_chunks").collect()) == [(1, "a"), (2, "c")]
