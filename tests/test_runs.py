import json

from pyspark.sql import functions as F

from tessera.operators import budget, vector
from tessera.plans import embed, review, summarise
from tessera.sources import connectors, files, hosts, store

FINDING = {"file": "a.py", "start_line": 2, "end_line": None, "category": "logic", "confidence": 0.9, "evidence": "`run_it` fails", "explanation": "wrong", "impact": "crash", "suggestion": None}
ANSWER = json.dumps({"summary": "s", "findings": [FINDING]})
DIFF = "--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n+run_it()\n"


def package(content="def f():\n  run_it()\n"):
    return budget.build_context(DIFF, [{"path": "a.py", "content": content, "hunks": 1}], [])


def test_review_and_publish(spark):
    contents = spark.createDataFrame([("a.py", "def f():\n  run_it()\n")], "path string, content string")
    got = review.review(spark, connectors.ScriptedChat({"run_it": ANSWER}), DIFF, package(), contents)
    rows = got.findings.collect()
    assert got.outcome == "findings" and rows[0].confidence == 0.9 and len(rows[0].fp_id) == 16
    host = connectors.MemoryHost(DIFF, comments=[{"fp_id": "gone", "line_id": "x", "resolved": False}])
    review.publish(host, got, ["a.py"], {"keyword": 1})
    assert host.comments[0]["resolved"] and not host.comments[1]["resolved"] and len(host.summaries) == 1
    clean = review.review(spark, connectors.ScriptedChat({}), DIFF, package(), contents)
    assert clean.outcome == "clean"
    vague = review.review(spark, connectors.ScriptedChat({"run_it": "I found a bug here", "found a bug": "still prose"}), DIFF, package(), contents)
    assert vague.outcome == "inconclusive"


def test_review_from_a_diff(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.append("files", spark.createDataFrame([(1, "a.py", "h", "python"), (2, "b.py", "h", "python")], "id long, path string, hash string, language string").withColumn("indexed_at", F.current_timestamp()))
    s.append("imports", spark.createDataFrame([(2, "a.py", None, "direct")], "file_id long, source_path string, imported_names array<string>, kind string"))
    contents = spark.createDataFrame([("a.py", "def f():\n  run_it()\n"), ("b.py", "from_b = 1")], "path string, content string")
    seen = []

    class Listens(connectors.ScriptedChat):
        def complete(self, system, user, max_tokens=None):
            seen.append(user)
            return ANSWER

    got = review.review_change(spark, Listens({}), s, DIFF, contents)
    assert got.outcome == "findings" and "from_b" in seen[0] and "run_it" in seen[0]
    paths = spark.createDataFrame([(0, "z"), (1, "a")], "ord int, path string")
    ranked = spark.createDataFrame([("a", 9.0), ("m", 1.0), ("n", 2.0)], "path string, score double")
    assert [r.path for r in review.changed_and_related(paths, ranked).orderBy("ord").collect()] == ["z", "a", "n", "m"]


def test_review_finds_files_by_their_vectors(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    names = ["a.py", "near.py", "code.py", "far.py"]
    s.append("files", spark.createDataFrame([(i, n, "h", "python") for i, n in enumerate(names)], "id long, path string, hash string, language string").withColumn("indexed_at", F.current_timestamp()))
    s.append("symbols", spark.createDataFrame([(10 + i, i, f"f{i}", "function", 1, 1, "") for i in range(4)], store.TABLES["symbols"]))
    s.append("code_chunks", spark.createDataFrame([(100, 0, 1, 1, "alpha beta gamma", "h"), (102, 2, 1, 1, "alpha beta gamma", "h"), (103, 3, 1, 1, "omega psi chi", "h")], store.TABLES["code_chunks"]))
    contents = spark.createDataFrame([("a.py", "run_it = 1\n"), ("near.py", "from_near = 2"), ("code.py", "from_code = 3"), ("far.py", "from_far = 4")], "path string, content string")

    class Describes:  # local, so that it travels to the workers by value
        def complete(self, system, user, max_tokens=None):
            if "far.py" in user:
                return "something else altogether"
            return "loads the settings of a tool" if "the file" in user.split("\n")[0] and "code.py" not in user else "one part"

    class Listens(connectors.ScriptedChat):
        def complete(self, system, user, max_tokens=None):
            seen.append(user)
            return ANSWER

    seen = []
    review.review_change(spark, Listens({}), s, DIFF, contents)
    assert not any(n in seen[0] for n in ("from_near", "from_code", "from_far")) and s.read("summary_embeddings").count() == 0
    summarised = review.summarise_missing(s, contents, Describes(), ["near.py", "far.py", "none.py"])
    assert summarised.files == 2 and review.summarise_missing(s, contents, Describes(), ["near.py"]) is None
    embedder = vector.HashingEmbedder(64)
    review.review_change(spark, Listens({}), s, DIFF, contents, embedder=embedder, summary_model=Describes())
    assert "from_near" in seen[1]  # by its summary's vector alone
    assert "from_code" in seen[1]  # by its code's vector alone
    assert {r.file_id for r in s.read("summaries").where("level = 'file'").collect()} >= {0, 1, 2}  # the changed and the shown have one now
    again = embed.embed_store(s, embedder)
    assert again.chunks == 0 and embed.embed_store(s, embedder) == embed.Embedded()
    assert s.read("code_embeddings").count() == 3 and s.read("summary_embeddings").count() == s.read("summaries").count()


def test_pressure_shrinks_the_prompt(spark):
    sizes = []

    class Tired:
        def complete(self, system, user, max_tokens=None):
            sizes.append(len(user))
            if len(user) > 50_000:
                raise connectors.ProviderError(503, "busy")
            return ANSWER

    held = package("x = 1\n" * 8000)
    answer, trimmed, notes = review.ask(Tired(), "s", review.report.user_prompt, held, DIFF, 90_000)
    assert answer == ANSWER and trimmed and len(notes) == 1 and sizes == sorted(sizes, reverse=True)


def test_evaluation(spark, tmp_path):
    schema = "name string, diff string, files map<string,string>, conventions string, expected_findings array<struct<file:string,start_line:int,category:string,acceptable_categories:array<string>>>"
    rows = [("hit", "hit-diff", {"a.py": "x\ny"}, None, [("a.py", 4, "security", None)]), ("quiet", "quiet-diff", {"b.py": "x"}, "use tabs", [])]
    results, total = review.run_evaluation(spark.createDataFrame(rows, schema), connectors.ScriptedChat({"hit-diff": ANSWER}))
    assert {(r.fixture, r.tp, r.fp, r.fn, r.inconclusive) for r in results.collect()} == {("hit", 1, 0, 0, False), ("quiet", 0, 0, 0, False)}
    assert total.first().gates_passed and review.experiment_events(results, "m").count() == 3
    files.save_record(review.record(results, total, "abc"), str(tmp_path / "history"))
    assert files.load_history(spark, str(tmp_path / "history")).first().per_fixture[0].name == "hit"


def test_hosts():
    sent = []

    def request(method, url, headers, body):
        sent.append((method, url, json.loads(body) if body else None))
        if url.endswith("/files"):
            return 200, {}, '[{"filename": "a.py"}]'
        if "notes?" in url:
            page = int(url.rsplit("=", 1)[1])
            return 200, {"x-next-page": "2" if page == 1 else ""}, json.dumps([{"id": page, "body": f"{hosts.ID_MARK}f{page}{hosts.MARK_END}"}])
        if url.endswith("/discussions"):
            return 400, {}, "no such line"
        if url.endswith("/changes"):
            return 200, {}, '{"changes": [{"old_path": "a", "new_path": "b", "diff": "@@"}]}'
        if url.endswith("/comments") and method == "GET":
            return 200, {}, json.dumps([{"id": 7, "body": f"{hosts.ID_MARK}x{hosts.MARK_END}{hosts.LINE_MARK}y{hosts.MARK_END}"}])
        return 200, {}, json.dumps({"head": {"sha": "s"}, "diff_refs": {"base_sha": "b"}})

    hub = hosts.GitHubHost("t", request, "o/r", 5)
    assert hub.fetch_changed_paths() == ["a.py"] and hub.prior_fingerprints() == [{"fp_id": "x", "line_id": "y"}]
    hub.post_findings([{"body": "b", "file": "a.py", "start_line": 3}])
    hub.resolve_stale([{"fp_id": "x"}])
    assert sent[-1][0] == "PATCH" and sent[-1][1].endswith("/pulls/comments/7")
    lab = hosts.GitLabHost("t", request, "g/p", 2)
    assert lab.fetch_diff() == "--- a/a\n+++ b/b\n@@\n" and "g%2Fp" in lab.merge
    assert [p["fp_id"] for p in lab.prior_fingerprints()] == ["f1", "f2"]
    lab.post_findings([{"body": "b", "file": "a.py", "start_line": 3}])
    assert sent[-1][1].endswith("/notes")
    lab.resolve_stale([{"fp_id": "f2"}])
    assert sent[-1][0] == "PUT" and sent[-1][1].endswith("/notes/2")


def describes(silent=(), fails=None):
    """A model that answers batches but for the names in `silent`, or fails as told."""

    class Describes:  # local, so that it travels to the workers by value
        def complete(self, system, user, max_tokens=None):
            if fails:
                raise connectors.ProviderError(fails, "busy")
            if system == summarise.BATCH_SYSTEM:
                names = [line[3:].split(" (")[0] for line in user.split("\n") if line.startswith("## ")]
                return json.dumps({n: f"{n} in a batch" for n in names if n not in silent})
            return "whole file" if "the file" in user.split("\n")[0] else "asked alone"

    return Describes()


def summary_store(spark, path):
    s = store.Store(spark, path)
    s.append("files", spark.createDataFrame([(1, "a.py", "h", "python"), (2, "b.py", "h", "python"), (3, "gone.py", "h", "python")], "id long, path string, hash string, language string").withColumn("indexed_at", F.current_timestamp()))
    rows = [(10, 1, "f", "function", 1, 1, ""), (11, 1, "g", "function", 2, 2, ""), (12, 1, "C", "class", 3, 3, ""), (20, 2, "h", "method", 1, 1, ""), (30, 3, "z", "function", 1, 1, ""), (21, 2, "late", "method", 9, 9, "")]
    s.append("symbols", spark.createDataFrame(rows, "id long, file_id long, name string, kind string, start_line int, end_line int, signature string"))
    return s


def test_summaries_are_made_once(spark, tmp_path):
    s = summary_store(spark, str(tmp_path / "s"))
    contents = spark.createDataFrame([("a.py", "def f()\ndef g()\nclass C"), ("b.py", "def h()")], "path string, content string")
    got = summarise.summarise(s, contents, describes(silent=("g",)))
    assert (got.symbols, got.files, got.errors, got.symbols_unchanged, got.stopped) == (3, 2, 0, 0, {})
    held = {(r.symbol_id, r.file_id): r.summary for r in s.read("summaries").collect()}
    assert held == {(10, None): "f in a batch", (11, None): "asked alone", (20, None): "asked alone", (None, 1): "whole file", (None, 2): "whole file"}
    again = summarise.summarise(s, contents, describes(fails=500))
    assert (again.symbols, again.symbols_unchanged, again.files_unchanged, again.errors) == (0, 3, 2, 0)
    old = s.read("summaries").where("symbol_id = 20").select("id")
    s.append("summary_embeddings", old.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    changed = spark.createDataFrame([("a.py", "def f()\ndef g()\nclass C"), ("b.py", "def h(x)")], "path string, content string")
    third = summarise.summarise(s, changed, describes(), paths=spark.createDataFrame([("b.py",)], "path string"))
    assert (third.symbols, third.files, third.files_unchanged) == (1, 0, 1)  # the summary reads as before, so the file's is fresh
    assert s.read("summaries").count() == 5 and s.read("summary_embeddings").count() == 0
    assert not list((tmp_path / "s" / "runs").glob("*"))


def test_pressure_ends_a_run(spark, tmp_path):
    s = summary_store(spark, str(tmp_path / "s"))
    contents = spark.createDataFrame([("a.py", "def f()\ndef g()"), ("b.py", "def h()")], "path string, content string")
    got = summarise.summarise(s, contents, describes(fails=429))
    assert got.stopped == {"batches": "full_batch"} and got.rate_limited and got.provider_limited and got.symbols == got.files == 0
    plain = summarise.summarise(s, contents, describes(fails=400))
    assert plain.stopped == {} and plain.errors == 4 and not plain.provider_limited  # one batch, then three symbols alone
    assert s.read("summaries").count() == 0
