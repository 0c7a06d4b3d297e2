"""Operators whose groups may be huge: no group, log or page passes through one task."""

import math
import random
import re
import subprocess
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera import fixed
from tessera.operators import chunks, evaluate, graph, pages, retrieval
from tessera.plans import queries
from tessera.sources import files


def plain_commits(lines):
    sha, out = None, []
    for i, line in enumerate(lines):
        if len(line) == 40 and all(c in "0123456789abcdef" for c in line):
            sha = line
        elif line.strip() and sha:
            out.append((sha, i, line))
    return out


@pytest.mark.parametrize("run", [1, 7, 100_000])
def test_commits_over_runs_of_lines(spark, run):
    rng = random.Random(run)
    lines = ["before any commit", ""]
    for c in range(60):
        lines += [f"{c:040x}", ""] + [rng.choice([f"f{rng.randrange(9)}.rs", " ", f"{c:039x}"]) for _ in range(rng.choice([0, 1, 2, 30]))]
    got = files.commit_files(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"), run)
    assert sorted(map(tuple, got.collect())) == sorted(plain_commits(lines))


def test_a_large_log_is_read_in_parts(spark, tmp_path):
    want = 0
    for part in range(3):
        with open(tmp_path / f"{part}.log", "w") as f:
            for c in range(20_000):
                names = [f"src/m{c % 97}/f{k}.rs" for k in range(c % 4)]
                f.write(f"{files.RECORD_MARK}{part * 10**6 + c:040x}\n\n" + "".join(n + "\n" for n in names))
                want += len(names)
    option = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(option)
    spark.conf.set(option, "256k")
    try:
        got = files.read_log(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 8
        plan = got._jdf.queryExecution().toString()
        assert "Window" not in plan and "Exchange" not in plan
        assert got.count() == want
        assert got.where("commit = '" + f"{10**6 + 3:040x}" + "'").orderBy("pos").select("pos", "file").collect() == [(k, f"src/m3/f{k}.rs") for k in range(3)]
    finally:
        spark.conf.set(option, before)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x").write_text(f"{files.RECORD_MARK}no commit\nf\n")
    with pytest.raises(Exception, match="no commit opens the record"):
        files.read_log(spark, str(tmp_path / "bad")).collect()


def test_log_of_a_repository(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for names in (["a.py"], ["a.py", "d/b c.py"], ["e.py"]):
        for n in names:
            (repo / n).parent.mkdir(exist_ok=True)
            (repo / n).write_text(str(random.random()))
        git("add", "-A")
        git("commit", "-qm", "m")
    got = files.git_log(spark, str(repo), str(tmp_path)).collect()
    assert sorted((r.pos, r.file) for r in got) == [(0, "a.py"), (0, "a.py"), (0, "e.py"), (1, "d/b c.py")] and len({r.commit for r in got}) == 3
    assert len({r.commit for r in files.git_log(spark, str(repo), str(tmp_path), 1).collect()}) == 1


def plain_percentile(values, p):
    values = sorted(v for v in values if v is not None)
    return values[min(math.ceil(len(values) * p / 100) + 1, len(values)) - 1] if values else None


def test_percentiles_equal_a_sort(spark, monkeypatch):
    rng = random.Random(0)
    groups = {"wide": [rng.gauss(0, 1) for _ in range(9000)], "tied": [rng.choice([0.0, 0.0, 1.0]) for _ in range(5000)], "one": [3.0], "two": [2.0, 1.0], None: [5.0, 7.0, 6.0], "nulls": [None, None, 4.0], "none": [None]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    percents = (0, 1, 50, 95, 99, 100)
    want = {g: tuple(plain_percentile(vs, p) for p in percents) for g, vs in groups.items() if any(v is not None for v in vs)}
    for sketch in (10_000, 200):  # whole groups, and brackets of a sketch
        monkeypatch.setattr(evaluate, "SKETCH", sketch)
        got = evaluate.percentile_index(rows, "v", percents, "g")
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_percentiles_sort_only_a_bracket(spark):
    rows = spark.range(200_000).select(F.lit("g").alias("g"), F.xxhash64("id").cast("double").alias("v"))
    got = evaluate.percentile_index(rows, "v", (50, 99), "g")
    values = [r.v for r in rows.collect()]
    assert tuple(got.first())[1:] == (plain_percentile(values, 50), plain_percentile(values, 99))


def plain_greedy(pairs):
    taken, out = set(), []
    for f, a in sorted({(f, a) for f, a, _ in pairs}):
        free = [e for g, b, e in sorted(pairs) if (g, b) == (f, a) and (f, e) not in taken]
        if free:
            taken.add((f, free[0]))
            out.append((f, a, free[0]))
    return out


def test_greedy_matching_equals_the_loop(spark):
    for seed in range(4):
        rng = random.Random(seed)
        pairs = sorted({(rng.choice("xyz"), rng.randrange(14), rng.randrange(10)) for _ in range(70)})
        got = evaluate.greedy_matches(spark.createDataFrame(pairs + pairs[:5], "fixture string, a_ord long, e_ord long"))
        assert sorted(map(tuple, got.select("fixture", "a_ord", "e_ord").collect())) == plain_greedy(pairs)
    assert evaluate.greedy_matches(spark.createDataFrame([], "fixture string, a_ord long, e_ord long")).collect() == []


def test_greedy_matching_of_one_large_fixture(spark):
    """100,000 findings of one fixture, each near three expected ones."""
    n = 100_000
    rows = spark.range(n).select(F.lit("f").alias("fixture"), F.col("id").alias("a_ord"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.xxhash64("id") % n)).alias("e_ord"))
    got = {r.a_ord: r.e_ord for r in evaluate.greedy_matches(rows).collect()}
    free, want, held = set(), {}, {}
    for r in rows.collect():
        held.setdefault(r.a_ord, []).append(r.e_ord)
    for a in range(n):
        e = next((e for e in sorted(held[a]) if e not in free), None)
        if e is not None:
            free.add(e)
            want[a] = e
    assert got == want


def test_pages_read_only_their_parts(spark, tmp_path):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "b", "ü", None]), rng.randrange(30), i) for i in range(2000)]  # keys that repeat
    made = pages.write_pages(spark.createDataFrame(rows, "k string, n long, v long"), ["k", "n"], str(tmp_path / "p"), 150)
    assert len(made) == 2000 and len(made.parts) >= 10
    seen = []
    for number in range(0, 9):
        page = made.page(number, 260)
        assert len({f.split("part=")[1].split("/")[0] for f in page.inputFiles()}) <= 4
        seen += [tuple(r) for r in page.collect()]
    assert sorted(seen, key=str) == sorted(rows, key=str) and len(seen) == 2000
    order = [pages.rank(r[:2]) for r in seen]
    assert order == sorted(order)
    assert made.page(8, 260).count() == 0 and made.page(7, 260).count() == 180
    again = pages.Pages(spark, str(tmp_path / "p"), ["k", "n"])
    assert [tuple(r) for r in again.page(3, 260).collect()] == seen[780:1040]
    key, walked = (None, -1), []
    while part := [tuple(r) for r in again.after(key, 400).collect()]:
        assert all(pages.rank(r[:2]) > pages.rank(key) for r in part)
        walked += part
        key = part[-1][:2]
        walked += [r for r in seen if r[:2] == key and r not in part]  # the rest of a key that a page was cut in
    assert sorted(walked, key=str) == sorted(rows, key=str)
    none = pages.write_pages(spark.createDataFrame([], "k string, n long"), ["k"], str(tmp_path / "none"))
    assert len(none) == 0 and none.page(0, 10).count() == 0


def test_chunking_scan_counts_what_it_skips(spark):
    rows = [(1, "py", "a\nb"), (2, "py", "c"), (3, None, "x"), (4, "", "x"), (5, "py", None), (6, "py", ""), (7, "py", "z" * 1_000_001)]
    files_ = spark.createDataFrame(rows, "file_id long, language string, content string")
    stored = chunks.line_chunks(spark.createDataFrame([(1, "a\nb"), (2, "old"), (9, "gone")], "file_id long, content string"))
    new, counts = chunks.scan(files_, stored)
    assert [(r.file_id, r.content) for r in new.collect()] == [(2, "c")]
    assert counts.first().asDict() == {"files": 7, "no_language": 2, "outside_root": 0, "no_text": 1, "too_large": 1, "empty": 1, "unchanged": 1, "chunked": 1, "chunks": 1}


def plain_cochange(rows, min_commits, min_correlation, most):
    firsts = defaultdict(dict)
    for c, p, f in rows:
        if f is not None:
            firsts[c][f] = min(firsts[c].get(f, p), p)
    kept = {c: [f for _, f in sorted((p, f) for f, p in fs.items())[:most]] for c, fs in firsts.items()}
    n = Counter(f for fs in kept.values() for f in fs)
    pairs = Counter(p for fs in kept.values() for p in combinations(sorted(fs), 2))
    return {(a, b): (k, k / math.sqrt(n[a] * n[b])) for (a, b), k in pairs.items() if k >= min_commits and k / math.sqrt(n[a] * n[b]) >= min_correlation}


def dealt(df):
    """Into how many parts the plan deals rows, by the first key."""
    return {(k, int(n)) for k, n in re.findall(r"hashpartitioning\((\w+)#[^)]*?, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


@pytest.fixture
def one_shuffle_partition(spark):
    option = "spark.sql.shuffle.partitions"
    before = spark.conf.get(option)
    spark.conf.set(option, "1")
    yield
    spark.conf.set(option, before)


def test_cochange_tasks_grow_in_number(spark, one_shuffle_partition, monkeypatch):
    """Commits, huge ones too, and pairs are shared by tasks that follow the rows, whatever the session's partitions."""
    rng = random.Random(0)
    rows = [(c, rng.randrange(9), f"f{rng.randrange(30)}") for c in range(400) for _ in range(rng.choice([1, 2, 5, 12]))]
    rows += [(-1, rng.randrange(50), f"f{i % 3000}") for i in range(4000)] + [(c, 0, None) for c in range(9)]
    table = spark.createDataFrame(rows, "commit long, pos int, file string")
    found = []
    for size in (500, 100_000):
        monkeypatch.setattr(graph, "TASK_ROWS", size)
        for most in (3, 50):
            got = graph.cochange(table, 2, 0.05, most)
            n = graph.tasks(table.where("file IS NOT NULL"))
            assert n >= sum(r[2] is not None for r in rows) / size and (n > 10 or size > 500)
            assert n == 1 or dealt(got) == {("commit", n), ("bucket", n), ("file_a", n)}
            want = plain_cochange(rows, 2, 0.05, most)
            assert {(r.file_a, r.file_b): (r.commit_count, pytest.approx(r.correlation)) for r in got.collect()} == want
            found.append(len(want))
    assert min(found) > 20


def test_distinct_edges_tasks_grow_in_number(spark, one_shuffle_partition, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    rng = random.Random(1)
    imports = [(rng.randrange(40), f"p{rng.randrange(60)}") for _ in range(2000)]
    files_ = [(100 + i, f"p{i}") for i in range(50)]
    edges = {(a, 100 + int(p[1:])) for a, p in imports if int(p[1:]) < 50}
    imports = spark.createDataFrame(imports, "file_id long, source_path string")
    files_ = spark.createDataFrame(files_, "id long, path string")
    back = graph.reverse_imports(imports, files_)
    assert dealt(back) == {("target_id", 20)}
    assert sorted((f, t) for t, f in back.collect()) == sorted(edges)
    pairs = [(1, 105, 0.5, 3), (7, 8, 0.4, 3), (8, 9, 0.1, 3)]
    forward = graph.import_edges(imports, files_).selectExpr("file_id AS file", "target_id AS other")
    both = graph.structural_union(forward, spark.createDataFrame(pairs, "file_a long, file_b long, correlation double, commit_count long"))
    assert dealt(both) == {("file", graph.tasks(forward))} and graph.tasks(forward) > 10
    assert sorted(map(tuple, both.collect())) == sorted(edges | {(1, 105), (105, 1), (7, 8), (8, 7)})


@pytest.mark.parametrize("name", ["edges_bidirectional", "fused_score", "method_counts"])
def test_queries_over_pairs_deal_them_out(spark, one_shuffle_partition, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    assert {("commit", 12), ("bucket", 12), ("file_a", 12)} <= dealt(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["fused_score", "method_counts", "keyword_hits", "retrieve_ranked"])
def test_words_of_files_are_dealt_out(spark, one_shuffle_partition, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    size = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    assert size > 100_000 and ("file_id", -(-(size // 20) // 500)) in dealt(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_method_counts_copies_no_rows(spark):
    """One row of flags for each file: rows are not expanded for each method; nulls, repeats and unknown methods count for nothing."""
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "other", "structural", "keyword"])) for _ in range(300)] + [(99, "semantic")] * 3
    table = spark.createDataFrame(rows, "file_id long, method string")
    got = retrieval.method_counts(table)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first().asDict() == {m: len({f for f, k in rows if k == m and f is not None}) for m in fixed.WEIGHTS}
    assert tuple(retrieval.method_counts(table.limit(0)).first()) == (0, 0, 0, 0)
    assert [(f.dataType.simpleString(), f.nullable) for f in got.schema] == [("bigint", False)] * 4


def test_cochange_tasks_get_like_shares(spark, monkeypatch):
    """The fullest of a hundred tasks gets less than 1.7 times the mean of the commits."""
    monkeypatch.setattr(graph, "TASK_ROWS", 600)
    table = spark.range(60_000).select(F.col("id").alias("commit"), F.lit(0).alias("pos"), F.col("id").alias("file"))
    assert graph.tasks(table) == 100
    shares = table.select(F.pmod(F.xxhash64("commit"), F.lit(graph.BUCKETS * 100)).alias("bucket")).repartition(100, "bucket").groupBy(F.spark_partition_id()).count()
    assert shares.agg(F.max("count")).first()[0] < 1.7 * 600
    assert f"{graph.BUCKETS * 100})" in graph.cochange(table)._jdf.queryExecution().optimizedPlan().toString()
