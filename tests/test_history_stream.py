"""The stateful history gives the rows of the batch operators, however it is cut."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate
from tessera.streaming import history, incremental

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def record(hour, rng):
    return {"timestamp": (START + timedelta(hours=hour)).isoformat().replace("+00:00", "Z"), "git_sha": f"s{hour}", "precision": rng.choice([0.5, 0.7, 0.9, 1.0]), "recall": rng.choice([0.4, 0.8]), "noise_rate": rng.choice([0.0, 0.1, 0.3])}


@pytest.fixture
def rocks(spark):
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option)
    spark.conf.set(option, history.PROVIDER)
    yield spark
    spark.conf.set(option, before)


def expected(spark, records, n):
    rows = spark.createDataFrame([(i, r["git_sha"], r["precision"], r["recall"], r["noise_rate"]) for i, r in enumerate(records)], "ord long, git_sha string, precision double, recall double, noise_rate double")
    flags = {r.ord: (r.precision_drop, r.recall_drop, r.noise_rise) for r in evaluate.regressions(rows).collect()}
    out = {}
    for i, r in enumerate(records):
        t = evaluate.trend(rows.where(F.col("ord") <= i), n=n).first() if i in (0, 3, len(records) - 1) else None
        out[r["git_sha"]] = (flags[i], None if t is None else (t.records, t.precision_trend, t.recall_trend, t.noise_rate_trend))
    return out


@pytest.mark.parametrize("cuts", [[12], [1, 2, 5, 9]])
def test_any_cut_gives_the_batch_rows(rocks, tmp_path, cuts):
    rng = random.Random(3)
    records = [record(h, rng) for h in range(12)]
    arriving = list(records)
    arriving[4], arriving[6] = arriving[6], arriving[4]  # two out of order, within the watermark
    last = [record(h, rng) for h in (200, 300)]  # move the watermark past the rest
    (tmp_path / "in").mkdir()
    parts = [arriving[a:b] for a, b in zip([0, *cuts], [*cuts, len(arriving)])] + [[x] for x in last]
    for k, part in enumerate(p for p in parts if p):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
        stream = history.changes(incremental.history_stream(rocks, str(tmp_path / "in")), late="1 day", n=4)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()  # each part after a restart
        assert q.awaitTermination(120)
    got = {r.git_sha: r for r in rocks.read.parquet(str(tmp_path / "out")).collect()}
    want = expected(rocks, records, 4)
    assert set(want) <= set(got)
    for sha, (flags, trend) in want.items():
        r = got[sha]
        assert (r.precision_drop, r.recall_drop, r.noise_rise) == flags, sha
        if trend:
            assert r.records == trend[0] and [round(x, 9) for x in (r.precision_trend, r.recall_trend, r.noise_rate_trend)] == [round(x, 9) for x in trend[1:]]


def test_change_of_a_first_record():
    assert history.change([], (0, None, 0.5, 0.5, 0.1)) == (None, None, None, 1, 0.0, 0.0, 0.0)
