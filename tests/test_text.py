from pyspark.sql import functions as F

from tessera.functions import jsonx, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_chunk_windows(spark):
    ten = "\n".join(f"l{i}" for i in range(1, 11))
    got = one(spark, text.chunk_windows(F.col("t"), 5, 2), t=ten)
    assert [(c.start_line, c.end_line) for c in got] == [(1, 5), (4, 8), (7, 10), (10, 10)]
    assert got[1].content == "l4\nl5\nl6\nl7\nl8"
    assert one(spark, text.chunk_windows(F.col("t"), 5, 2), t="") is None
    assert len(one(spark, text.chunk_windows(F.col("t"), 3, 3), t=ten)) == 1
    assert one(spark, text.lines(F.col("t")), t="a\r\nb\n\nc\n") == ["a", "b", "", "c"]


def test_fingerprints_and_tokens(spark):
    assert one(spark, text.normalize_evidence(F.col("t")), t="  A \u00a0b\n\tC ") == "a b c"
    assert one(spark, text.estimate_tokens(F.col("t")), t="äöü") == 2
    assert len(one(spark, text.content_fingerprint(F.lit("f"), F.lit("c"), F.col("t")), t="e")) == 16


def test_diff_scalars(spark):
    diff = "--- a/x\n+++ b/src/x.rs\n@@ -1 +1 @@\n+let foo_bar = Äb1(3ab, xy);\n-old_name\n+++ b/gone\n+++ /dev/null"
    assert one(spark, text.diff_identifiers(F.col("t")), t=diff) == ["foo_bar", "let", "Äb1"]
    assert one(spark, text.changed_paths(F.col("t")), t=diff) == ["gone", "src/x.rs"]


def test_code_candidates(spark):
    got = one(spark, text.code_candidates(F.col("t")), t="The `a b` call to delete_all(Store) is not `x` This fooBar")
    assert got == ["Store", "a b", "delete_all", "fooBar"]


def test_dismissal(spark):
    d = text.is_self_dismissed(F.col("a"), F.col("b"))
    assert one(spark, d, a="There is No Bug here", b="") is True
    assert one(spark, d, a="x", b="minimal impact on users") is False
    assert one(spark, d, a="x", b="minimal impact") is True
    assert one(spark, d, a="x", b="data loss") is False


def test_claims(spark):
    assert one(spark, text.claims_findings(F.col("t")), t="Two  issues\nfound") is True
    assert one(spark, text.claims_findings(F.col("t")), t="no issues found") is False


def test_line_slice(spark):
    s = text.line_slice(F.col("t"), F.lit(2), F.lit(9))
    assert one(spark, s, t="a\nb\nc") == "b\nc" and one(spark, s, t="a") is None


FINDING = '{"file":"a","start_line":3,"end_line":null,"category":"logic","confidence":0.8,"evidence":"e","explanation":"x","impact":"i","suggestion":null}'


def test_ladder_reaches_every_quality():
    parse = jsonx.parse_response
    assert parse('text {"summary":"s","findings":[%s]} more' % FINDING)["quality"] == "strict"
    assert parse('{"issues":[%s, {"file": 1}]}' % FINDING)["quality"] == "flexible"
    assert parse("[]")["quality"] == "array"
    cut = parse('{"summary":"s","findings":[%s,{"file":"b"' % FINDING)
    assert cut["quality"] == "salvaged" and len(cut["findings"]) == 1
    assert parse("nothing")["quality"] == "malformed"


def test_balanced_objects_ignore_braces_in_strings():
    assert jsonx.first_object('x {"a": "}\\"{", "b": {}} y') == '{"a": "}\\"{", "b": {}}'
    assert jsonx.first_object("{") is None


def test_sanitize():
    assert jsonx.sanitize("Let me think. The lock is never released.") == "The lock is never released."
    assert jsonx.sanitize("Actually fine") == "Actually fine"


def test_small_texts(spark):
    long = "é" * 501
    got = one(spark, F.struct(text.percent(F.lit(0.1256)).alias("p"), text.truncate_chars(F.col("t")).alias("t"), text.load_failure_kind(F.lit("HTTP status 429 Too Many Requests")).alias("k"), text.load_failure_kind(F.lit(None).cast("string")).alias("n")), t=long)
    assert (got.p, got.t, got.k, got.n) == ("12.6%", "é" * 500 + "...", "rate_limited", "other")
    for stamp in ("2024-03-05T06:07:08Z", "2024-03-05T06:07:08+00:00", "2024-03-05 06:07:08"):
        assert one(spark, text.experiment_name(F.col("s"), F.col("t")), s="abcdef0123456", t=stamp) == "abcdef0-20240305-060708"


def test_clean_stays_inside(tmp_path):
    from tessera.sources import files

    (tmp_path / "repo" / ".tessera" / "x").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    assert files.clean(str(tmp_path / "repo"), (".tessera", "../out", ".", "none")) == [str((tmp_path / "repo" / ".tessera").resolve())]
    assert (tmp_path / "out").exists() and (tmp_path / "repo").exists() and not (tmp_path / "repo" / ".tessera").exists()


def test_costs(spark):
    from tessera.operators import summaries

    rows = summaries.cost(spark.createDataFrame([("a" * 400, "b" * 40), (None, "c" * 40)], "prompt string, response string"), 3.0, 15.0)
    got = {r.units: (r.calls, round(r.cost, 9)) for r in summaries.extrapolate(rows, (2, 1000)).collect()}
    assert got == {2: (2, round((100 * 3 + 2 * 10 * 15) / 1e6, 9)), 1000: (2, round(500 * (100 * 3 + 2 * 10 * 15) / 1e6, 9))}
    assert summaries.extrapolate(rows.limit(0), (1,)).collect() == []


def test_paths_inside_the_root(spark):
    cases = {"a": True, "a/b.py": True, "./a/../b": True, "a//b": True, "..": False, "../a": False, "a/../../b": False, "/a": False, "": False, ".": False, "a/..": False, "..a/b": True}
    got = {r.p: r.ok for r in spark.createDataFrame([(p,) for p in cases], "p string").select("p", text.inside_root(F.col("p")).alias("ok")).collect()}
    assert got == cases
