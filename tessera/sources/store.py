"""Tables of the property graph as Parquet: commits over several tables, snapshots, key-wise merges and cascading deletes."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 3
TABLES = {
    "files": "id long, path string, hash string, language string, indexed_at timestamp",
    "symbols": "id long, file_id long, name string, kind string, start_line int, end_line int, signature string",
    "imports": "file_id long, source_path string, imported_names array<string>, kind string",
    "refs": "file_id long, symbol_name string, line int",
    "cochange": "file_id_a long, file_id_b long, correlation double, commit_count long",
    "summaries": "id long, symbol_id long, file_id long, level string, summary string, content_hash string, token_count int, generated_at timestamp",
    "code_chunks": "id long, file_id long, start_line int, end_line int, content string, content_hash string",
    "summary_embeddings": "id long, embedding array<float>",
    "code_embeddings": "id long, embedding array<float>",
    "feedback_signals": "id long, team_id string, signal_type string, finding_text string, finding_category string, ts timestamp",
    "feedback_embeddings": "id long, embedding array<float>",
    "batches": "source string, batch long",
}


#: The column that rows of a table are dealt to buckets by, and how many buckets a new store has, if it is not told.
BUCKET_BY = {"files": "id", "symbols": "file_id", "imports": "file_id", "refs": "file_id", "cochange": "file_id_a", "code_chunks": "file_id", "batches": "source"}
BUCKETS = 16
#: Columns that rows are looked up by beside the bucket's: a Bloom filter in each file tells which files can hold a value.
LOOKED_UP = {"files": ("id", "path"), "symbols": ("id", "name"), "summaries": ("id", "symbol_id", "file_id"), "code_chunks": ("id", "content_hash"), "refs": ("symbol_name",)}
#: Parts that a bucket may have before an append writes the table anew, versions that stay readable, rows asked for by one literal filter.
MOST_PARTS, KEPT_VERSIONS, MOST_LITERALS = 8, 3, 1000
#: What makes a folder a store, and the folder of its manifests.
MARKER, COMMITS, FORMAT = "store.json", "commits", "tessera-store"

Parts = dict[str, dict[str, list[str]]]


def key_id(*columns: str) -> F.Column:
    """A stable id from natural keys."""
    return F.xxhash64(*columns)


class Conflict(RuntimeError):
    """Another writer has committed a change of the same buckets."""


class Folder:
    """A folder by Hadoop's file systems, whatever store it lies in."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, path: str = "") -> list[str]:
        fs, p = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        fs, p = self._at(path)
        return (self.spark._jvm.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000

    def load(self, path: str) -> dict | None:
        """The JSON object of a file; None if it is missing or none of ours."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        f = fs.open(p)
        try:
            data = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f))
        finally:
            f.close()
        try:
            held = json.loads(data)
        except ValueError:
            return None
        return held if isinstance(held, dict) and held.get("format") == FORMAT else None

    def put_new(self, path: str, content: dict) -> bool:
        """Writes a file whole under another name, then gives it its name; False if that is taken. Of several writers one succeeds."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        fs, source = self._at(draft)
        out = fs.create(source, False)
        out.write(bytearray(json.dumps({"format": FORMAT, **content}).encode()))
        out.close()
        _, target = self._at(path)
        try:
            if fs.getScheme() == "file":  # a rename would replace a file, a link does not
                try:
                    os.link(source.toUri().getPath(), fs.makeQualified(target).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not fs.exists(target) and bool(fs.rename(source, target))
        finally:
            fs.delete(source, False)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Store:
    """A folder of tables in buckets. A commit is one manifest file, numbered and put in place at once, that lists the parts of every table.

    Readers take a manifest, the last or an earlier one, and so see all changes of a commit or none, also while others write
    and if a writer dies between any two of its writes. Changes of several tables go together in a transaction(). Two
    writers who change the same buckets: the later one gets a Conflict and nothing of its changes; other buckets: both count.

    Only buckets that a change touches are written, an append writes its rows alone. Parts that none of the last
    KEPT_VERSIONS manifests lists are deleted. A folder that holds anything else than a store is refused and not touched;
    of a store of another layout what its manifests list is removed. `buckets` counts for a new store.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), Folder(spark, root)
        held = self.folder.load(MARKER)
        if held is None:
            if self.folder.names():
                raise ValueError(f"{self.root} holds something that is no store")
            self.folder.put_new(MARKER, {"version": VERSION, "buckets": buckets})
            held = self.folder.load(MARKER)
        elif held["version"] != VERSION:
            self._remove_listed()
            self.folder.put_new(MARKER, {"version": VERSION, "buckets": buckets})
            held = self.folder.load(MARKER)
        self.buckets: int = held["buckets"]

    def versions(self) -> list[int]:
        """The commits that can be read, oldest first; drafts and other files don't count."""
        return [int(m[1]) for name in self.folder.names(COMMITS) if (m := re.fullmatch(r"(\d{20})\.json", name))]

    def version(self) -> int:
        """The last commit; 0 before the first."""
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> Parts:
        """The parts of each bucket of each table in a version, the last if not told."""
        version = self.version() if version is None else version
        if not version:
            return {}
        held = self.folder.load(manifest(version))
        if held is None:
            raise ValueError(f"version {version} is not kept")
        return held["tables"]

    def bucket(self, name: str) -> F.Column:
        return F.pmod(F.xxhash64(BUCKET_BY.get(name, "id")), F.lit(self.buckets)).cast("int")

    def rows(self, name: str, parts: Parts, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/{v}/bucket={b}" for b, held in parts.get(name, {}).items() if buckets is None or b in buckets for v in held]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table; a frame keeps to the version that was the last when it was made."""
        return self.rows(name, self.parts(version))

    def pruned(self, name: str, rows: list[dict]) -> list[str] | None:
        """The buckets that rows with these values can lie in; None if the values don't tell."""
        by = BUCKET_BY.get(name, "id")
        if not all(by in r for r in rows):
            return None
        kind = dict(c.split(" ", 1) for c in TABLES[name].split(", "))[by]
        at = F.pmod(F.xxhash64("v"), F.lit(self.buckets)).cast("string").alias("b")
        return [r["b"] for r in self.spark.createDataFrame([(r[by],) for r in rows], f"v {kind}").select(at).distinct().collect()]  # MOST_LITERALS at most

    def find_all(self, name: str, rows: list[dict] | DataFrame) -> DataFrame:
        """The stored rows that share the values of one of `rows`, all of which name the same columns.

        A list (MOST_LITERALS at most) becomes literals: only the buckets that can hold them are read, and in these only the
        files and row groups whose Bloom filters or ranges do. A frame of any size is joined, bucket by bucket if its
        columns tell the bucket.
        """
        if isinstance(rows, DataFrame):
            held = self.read(name)
            by = BUCKET_BY.get(name, "id")
            if by in rows.columns:
                wanted = [str(r["b"]) for r in rows.select(F.pmod(F.xxhash64(F.col(by).cast(held.schema[by].dataType)), F.lit(self.buckets)).alias("b")).distinct().collect()]  # one row for each bucket
                held = self.rows(name, self.parts(), wanted)
            return held.join(rows.distinct(), rows.columns, "left_semi")
        if len(rows) > MOST_LITERALS:
            raise ValueError(f"more than {MOST_LITERALS} rows: give a DataFrame")
        if not rows:
            return self.read(name).limit(0)
        held, keys = self.rows(name, self.parts(), self.pruned(name, rows)), list(rows[0])
        for k in keys:  # each column by itself reaches the scan
            held = held.where(F.col(k).isin([r[k] for r in rows]))
        if len(keys) > 1:
            each = F.lit(False)
            for r in rows:
                one = F.lit(True)
                for k in keys:
                    one = one & (F.col(k) == F.lit(r[k]))
                each = each | one
            held = held.where(each)
        return held

    def find(self, name: str, **keys) -> dict | None:
        """One row with these values, or None. A file's path is tried in the bucket of the id that build_graph() gives it first."""
        row = None
        if name == "files" and "path" in keys and "id" not in keys:
            made = self.spark.createDataFrame([(keys["path"],)], "path string").select(key_id("path").alias("id")).first()
            row = self.find_all(name, [keys | {"id": made["id"]}]).first()
        row = row or self.find_all(name, [keys]).first()
        return row.asDict() if row else None

    def transaction(self) -> Transaction:
        return Transaction(self)

    def write(self, name: str, rows: DataFrame) -> None:
        with self.transaction() as t:
            t.write(name, rows)

    def append(self, name: str, rows: DataFrame) -> None:
        with self.transaction() as t:
            t.append(name, rows)

    def upsert(self, name: str, rows: DataFrame, *keys: str, order: str | None = None) -> None:
        with self.transaction() as t:
            t.upsert(name, rows, *keys, order=order)

    def delete(self, name: str, keys: DataFrame) -> None:
        with self.transaction() as t:
            t.delete(name, keys)

    def delete_chunks(self, files: DataFrame) -> None:
        """Removes the chunks of files (file_id) and their vectors."""
        with self.transaction() as t:
            t.delete_chunks(files)

    def delete_summaries(self, files: DataFrame) -> None:
        """Removes the summaries of files (file_id) and of their symbols, and the vectors."""
        with self.transaction() as t:
            t.delete_summaries(files)

    def clear(self, path: str) -> None:
        """Removes a folder of a finished run below the store."""
        if not path.startswith(f"{self.root}/runs/"):
            raise ValueError(f"{path} is no run of {self.root}")
        self.folder.delete(path.removeprefix(f"{self.root}/"))

    def expire(self) -> None:
        """Drops the manifests before the last KEPT_VERSIONS, then the parts that only they list."""
        versions = self.versions()
        old, kept = versions[:-KEPT_VERSIONS], versions[-KEPT_VERSIONS:]
        if not old:
            return
        listed = lambda some: {path for v in some if (m := self.folder.load(manifest(v))) for path in paths_of(m["tables"])}
        gone = listed(old) - listed(kept)
        for v in old:
            self.folder.delete(manifest(v))
        for path in gone:
            self.folder.delete(path)

    def vacuum(self, older_than: float = 86_400) -> int:
        """Removes parts that no readable version lists and that are older than so many seconds: what dead writers left. How many."""
        listed = {path.rsplit("/", 1)[0] for v in self.versions() for path in paths_of(self.parts(v))}
        lost = [f"{name}/{part}" for name in TABLES for part in self.folder.names(name) if f"{name}/{part}" not in listed]
        lost += [f"{COMMITS}/{name}" for name in self.folder.names(COMMITS) if name.endswith(".draft")]
        lost = [path for path in lost if self.folder.age(path) >= older_than]
        for path in lost:
            self.folder.delete(path)
        return len(lost)

    def _remove_listed(self) -> None:
        for name in self.folder.names(COMMITS):
            for path in paths_of((self.folder.load(f"{COMMITS}/{name}") or {}).get("tables", {})):
                self.folder.delete(path)
            self.folder.delete(f"{COMMITS}/{name}")
        self.folder.delete(MARKER)

    def reset(self) -> None:
        """Empties the store; what else lies in its folder stays."""
        self._remove_listed()
        self.folder.put_new(MARKER, {"version": VERSION, "buckets": self.buckets})


def manifest(version: int) -> str:
    return f"{COMMITS}/{version:020}.json"


def paths_of(parts: Parts) -> set[str]:
    return {f"{name}/{v}/bucket={b}" for name, own in parts.items() for b, held in own.items() for v in held}


class Transaction:
    """Changes of one store that count together, from the commit at the end of the `with` block; an error in it leaves nothing.

    Reads see the store as it was at the start and the changes so far.
    """

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.before = store.parts(self.base)
        self.now: Parts = {t: {b: list(v) for b, v in own.items()} for t, own in self.before.items()}
        self.used: set[tuple[str, str]] = set()  # buckets whose rows this transaction rests on or replaces

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()

    def read(self, name: str, buckets: list[str] | None = None) -> DataFrame:
        every = list(map(str, range(self.store.buckets)))
        self.used |= {(name, b) for b in (every if buckets is None else buckets)}
        return self.store.rows(name, self.now, buckets)

    def _write(self, name: str, rows: DataFrame, replaced: list[str]) -> None:
        """New parts of rows; the parts of the replaced buckets are no longer read."""
        store, part = self.store, f"v{uuid.uuid4().hex}"
        columns = [c.strip().split(" ")[0] for c in TABLES[name].split(",")]
        by = BUCKET_BY.get(name, "id")
        out = rows.select(*columns, store.bucket(name).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", by).write
        for column in LOOKED_UP.get(name, ()):
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
        out.partitionBy("bucket").parquet(f"{store.root}/{name}/{part}")
        made = [b.removeprefix("bucket=") for b in store.folder.names(f"{name}/{part}") if b.startswith("bucket=")]
        own = {b: v for b, v in self.now.get(name, {}).items() if b not in replaced}
        for b in made:
            own[b] = [*own.get(b, []), part]
        self.now[name] = own
        self.used |= {(name, b) for b in replaced}

    def _touched(self, name: str, rows: DataFrame, exact: bool) -> list[str]:
        """Buckets that rows of these keys can be in; all, if the keys do not tell."""
        if not exact:
            return list(map(str, range(self.store.buckets)))
        return [str(r["b"]) for r in rows.select(self.store.bucket(name).alias("b")).distinct().collect()]  # one row for each bucket

    def touched_rows(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the buckets that rows with these keys lie in."""
        return self.read(name, self._touched(name, keys, BUCKET_BY.get(name, "id") in keys.columns))

    def write(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, list(map(str, range(self.store.buckets))))

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, [])
        many = [b for b, v in self.now[name].items() if len(v) > MOST_PARTS]
        if many:
            self._write(name, self.read(name, many), many)

    def upsert(self, name: str, rows: DataFrame, *keys: str, order: str | None = None) -> None:
        """Rows go before stored ones of the same keys; of rows that repeat a key the last by `order` counts, if given.
        The keys decide the bucket (for files, as their id comes from the path)."""
        rows = last_of(rows, order, *keys) if order else rows
        touched = self._touched(name, rows, name == "files" or BUCKET_BY.get(name, "id") in keys)
        held = self.read(name, touched)
        self._write(name, merge(held, rows.select(held.columns), *keys), touched)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Removes the rows that share the key columns of `keys`."""
        touched = self._touched(name, keys, BUCKET_BY.get(name, "id") in keys.columns)
        self._write(name, self.read(name, touched).join(keys, keys.columns, "left_anti"), touched)

    def replace(self, name: str, keys: DataFrame, rows: DataFrame) -> None:
        """delete() and append() in one write."""
        touched = self._touched(name, keys.unionByName(rows.select(keys.columns)), BUCKET_BY.get(name, "id") in keys.columns)
        held = self.read(name, touched)
        self._write(name, held.join(keys, keys.columns, "left_anti").unionByName(rows.select(held.columns)), touched)

    def delete_chunks(self, files: DataFrame) -> None:
        files = files.select("file_id")
        self.delete("code_embeddings", self.read("code_chunks").join(files, "file_id", "left_semi").select("id"))
        self.delete("code_chunks", files)

    def delete_summaries(self, files: DataFrame) -> None:
        files = files.select("file_id")
        symbols = self.read("symbols").join(files, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
        held = self.read("summaries")
        ids = held.join(files, "file_id", "left_semi").select("id").union(held.join(symbols, "symbol_id", "left_semi").select("id")).distinct()
        self.delete("summary_embeddings", ids)
        self.delete("summaries", ids)

    def commit(self) -> int:
        """Puts the manifest in place and gives its version. If others have committed since the start, their changes stay; if they
        changed a bucket that this transaction read or replaced, it is a Conflict."""
        store = self.store
        if self.now == self.before:
            return self.base
        base, under = self.base, self.before
        while not store.folder.put_new(manifest(base + 1), {"version": base + 1, "tables": self.now}):
            base = store.version()
            latest = store.parts(base)
            clash = sorted({f"{name}/{b}" for name, b in self.used if latest.get(name, {}).get(b) != self.before.get(name, {}).get(b)})
            if clash:
                raise Conflict(f"changed by another writer: {', '.join(clash[:5])}")
            for name in {*latest, *self.now}:
                for b in {*latest.get(name, {}), *self.now.get(name, {})}:
                    theirs, ours, old = (t.get(name, {}).get(b, []) for t in (latest, self.now, under))
                    if theirs != old:  # they replaced or added; we added at most
                        self.now.setdefault(name, {})[b] = [*theirs, *(v for v in ours if v not in old)]
            under = latest
        store.expire()
        return base + 1


def symbols_in_files(symbols: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols of the files at the paths (path), with the path, by kind, file and line."""
    held = files.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"), "path")
    return symbols.join(held, "file_id").orderBy("kind", "file_id", "start_line")


def symbol_summaries(summaries: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_id, name, level, summary) of the summarised symbols of files (file_id), by line."""
    own = symbols.join(files.select("file_id"), "file_id", "left_semi").select(F.col("id").alias("symbol_id"), "file_id", "name", "start_line")
    return summaries.select("id", "symbol_id", "level", "summary").join(own, "symbol_id").orderBy("file_id", "start_line").select("id", "file_id", "name", "level", "summary")


def file_ids(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id) of the stored files among the paths."""
    return files.join(paths.select("path"), "path", "left_semi").select("path", "id")


def chunks_of_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files (file_id) by line."""
    return chunks.join(files.select("file_id"), "file_id", "left_semi").orderBy("file_id", "start_line")


def chunks_by_hash(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """(content_hash, id) of the chunks with one of the hashes."""
    return chunks.join(hashes.select("content_hash"), "content_hash", "left_semi").select("content_hash", "id")


def merge(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def last_of(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of rows with the same key the last by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """New files (path, hash) whose stored hash is absent or another."""
    return new.join(old.select("path", F.col("hash").alias("_old")), "path", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).drop("_old")


def cascade_delete(parents: DataFrame, children: DataFrame, keys: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those that share a key of `keys`, and children without those of the removed parents."""
    gone = parents.join(keys, keys.columns, "left_semi").select(F.col(parent_key).alias(child_key))
    return parents.join(keys, keys.columns, "left_anti"), children.join(gone, child_key, "left_anti")


def build_graph(store: Store, extracted: DataFrame, hashes: DataFrame) -> dict[str, int]:
    """Replaces the rows of files whose hash changed, with all that hangs on them; the others are not touched. Gives counters."""
    files = hashes.join(extracted.select("path", "language").distinct(), "path").select(key_id("path").alias("id"), "path", "hash", "language", F.current_timestamp().alias("indexed_at"))
    total = files.count()
    changed = changed_files(store.read("files"), files).persist()  # read by every table below
    n, counts = changed.count(), {"symbols": 0, "imports": 0, "refs": 0}
    if n:
        ids = changed.select("path", F.col("id").alias("file_id"))
        rows = extracted.join(ids, "path")
        gone = ids.select("file_id")
        fresh = {
            "symbols": rows.where("kind = 'symbol'").select(key_id("path", "name", "detail", "line").alias("id"), "file_id", "name", F.col("detail").alias("kind"), F.col("line").alias("start_line"), "end_line", "signature"),
            "imports": rows.where("kind = 'import'").select("file_id", F.col("name").alias("source_path"), F.col("names").alias("imported_names"), F.col("detail").alias("kind")),
            "refs": rows.where("kind = 'reference'").select("file_id", F.col("name").alias("symbol_name"), "line"),
        }
        with store.transaction() as t:
            for name, new in fresh.items():
                t.replace(name, gone, new)
                counts[name] = new.count()
            t.upsert("files", changed, "path")
    changed.unpersist()
    return {"files": total, "changed": n, "unchanged": total - n, **counts}
