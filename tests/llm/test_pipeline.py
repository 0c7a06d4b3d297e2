"""The pipeline on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(n))
    rows, labels = [], []
    for i in range(700):
        t = text(rng.randint(20, 90))
        kind = "toxic" if i % 7 == 0 else "bad" if i % 7 == 1 else "good"
        if kind == "toxic":
            t = t + " idiot " + text(3)
        if kind == "bad":
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, int(kind != "bad"), int(kind == "toxic")))
    passage, near = text(60), text(80)
    rows += [(1000, near, "en", "s", 1), (1001, near.replace(near.split()[40], "other"), "en", "s", 1), (1002, near, "en", "s", 1)]
    rows += [(1010, text(40) + " " + passage, "en", "s", 1), (1011, text(40) + " " + passage + " " + text(30), "en", "s", 1)]
    rows += [(1020, text(30) + " you idiot", "en", "s", 1), (1030, None, "en", "s", None), (1031, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(700) if i % 7}
    assert 1020 not in kept["toxicity"] and len([i for i in kept["toxicity"] if i < 700 and i % 7 == 0]) <= 5 and clean <= set(kept["toxicity"])
    good = {i for i in clean if i % 7 != 1}
    assert good <= set(kept["quality"]) and len([i for i in kept["quality"] if i < 700 and i % 7 == 1]) <= 10  # of 100, from a few hundred labels
    assert good <= set(kept["simhash_neardup"]) and {1000, 1001, 1002} & set(kept["simhash_neardup"]) == {1000}
    assert passage in kept["substring_dedup"][1010].text and passage not in kept["substring_dedup"][1011].text
    assert set(kept["packing"]) == set(kept["substring_dedup"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_duplicates_are_what_the_shingles_say(spark, tmp_path):
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([30, 60, 100]))]
        for _ in range(3):  # one or two words changed: pairs on either side of 0.8
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = "new" + str(rng.random())
            texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(i for i in got if i is not None) == [i for i, r in enumerate(root) if i == r] and got.count(None) == 1


def test_repeated_passages_keep_every_row(spark, tmp_path):
    passage, own = " ".join(f"p{i}" for i in range(30)), lambda k: " ".join(f"o{k}_{i}" for i in range(10))
    rows = [(1, passage + " " + own(1)), (2, own(2) + " " + passage), (2, own(2) + " " + passage), (3, own(3)), (3, own(4)), (None, own(5)), (None, passage), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_repeated_passages(spark, docs, str(tmp_path)).collect()
    want = [(1, passage + " " + own(1)), (2, own(2)), (2, own(2)), (3, own(3)), (3, own(4)), (None, own(5)), (None, passage), (4, "")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)


EXTRA = ["kept", "text_sha256", "fingerprint", "bucket", "component_id", "row", "new", "digest", "gone_id", "score"]


def test_clashing_columns_pass_every_stage(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"t{rng.randint(0, 9000)}" for _ in range(n))
    passage, near = text(40), text(60)
    rows = [(i, text(30)) for i in range(40)] + [(50, passage + " " + text(9)), (51, text(9) + " " + passage), (60, near), (61, near), (61, near), (None, near), (70, None), (71, "")]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *EXTRA]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *(f"{c} of {k}" for c in EXTRA)) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    want = {k: (i, t) for k, (i, t) in enumerate(rows)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns and spark.conf.get(option) == before, name
        held = docs.collect()
        for r in held:
            k = int(r["kept"].split(" of ")[1])
            assert [r[c] for c in EXTRA] == [f"{c} of {k}" for c in EXTRA] and r["doc_id"] == want[k][0], name
            if name != "substring_dedup":
                assert r["text"] == want[k][1]
    left = {int(r["kept"].split(" of ")[1]): r["text"] for r in held}
    assert passage not in left[41] and passage in left[40] and left[42] == near and 43 not in left and left[45] == near
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= 40


def test_stages_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == [], name
