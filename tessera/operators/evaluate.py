"""Scores of findings against what was expected, and their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.sources import shared


def categories_match(actual: Column, expected: Column, acceptable: Column | None = None) -> Column:
    """Equal, accepted by the row, or one of the symmetric alias pairs."""
    out = actual == expected
    for a, b in fixed.CATEGORY_ALIASES:
        out |= ((actual == a) & (expected == b)) | ((actual == b) & (expected == a))
    return out if acceptable is None else out | F.coalesce(F.array_contains(acceptable, actual), F.lit(False))


def match_candidates(expected: DataFrame, actual: DataFrame, tolerance: int = fixed.LINE_TOLERANCE) -> DataFrame:
    """(fixture, e_ord, a_ord): pairs of one fixture and file whose categories match and whose lines are near.

    The lines are joined by bands of the tolerance's width, so a file with many findings is not paired in full.
    """
    width = tolerance + 1
    e = expected.select("fixture", "file", F.col("ord").alias("e_ord"), F.col("start_line").alias("e_line"), F.col("category").alias("e_category"), "acceptable").withColumn("band", F.explode(F.array(*(F.floor(F.col("e_line") / width) + d for d in (-1, 0, 1)))))
    a = actual.select("fixture", "file", F.col("ord").alias("a_ord"), F.col("start_line").alias("a_line"), F.col("category").alias("a_category")).withColumn("band", F.floor(F.col("a_line") / width))
    near = (F.abs(F.col("e_line") - F.col("a_line")) <= tolerance) & categories_match(F.col("a_category"), F.col("e_category"), F.col("acceptable"))
    return e.join(a, ["fixture", "file", "band"]).where(near).select("fixture", "e_ord", "a_ord")


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """(fixture, a_ord, e_ord): of candidate pairs those that a loop over a_ord keeps which takes the least e_ord still free.

    All fixtures and findings go at once, in rounds: every a proposes to its least e, an e holds the least a that proposes
    to it, and pairs of that e with later a go. Earlier findings have the first say at every e, so a held proposal is lost only
    to an earlier finding, as in the loop, and where no pair goes any more the proposals are the loop's choices. A round
    is two aggregations and a join, by finding; rounds grow with the longest chain of findings that push each other on.
    """
    pairs, left = shared.checkpoint(pairs.select("fixture", "a_ord", "e_ord").distinct()), -1
    while (n := pairs.count()) != left:
        left = n
        asked = pairs.groupBy("fixture", "a_ord").agg(F.min("e_ord").alias("e_ord"))
        held = asked.groupBy("fixture", "e_ord").agg(F.min("a_ord").alias("first"))
        pairs = shared.checkpoint(pairs.join(held, ["fixture", "e_ord"], "left").where("first IS NULL OR a_ord <= first").select("fixture", "a_ord", "e_ord"))
    return pairs.groupBy("fixture", "a_ord").agg(F.min("e_ord").alias("e_ord"))


def fixture_results(fixtures: DataFrame, expected: DataFrame, actual: DataFrame, tolerance: int = fixed.LINE_TOLERANCE) -> DataFrame:
    """(fixture, expected, actual, tp, fp, fn): actual findings in order each take the first free expected one."""
    hits = greedy_matches(match_candidates(expected, actual, tolerance)).groupBy("fixture").agg(F.count("*").alias("tp"))
    counts = fixtures.select("fixture").join(expected.groupBy("fixture").agg(F.count("*").alias("expected")), "fixture", "left").join(actual.groupBy("fixture").agg(F.count("*").alias("actual")), "fixture", "left").join(hits, "fixture", "left").na.fill(0)
    return counts.select("fixture", "expected", "actual", "tp", (F.col("actual") - F.col("tp")).alias("fp"), (F.col("expected") - F.col("tp")).alias("fn"))


def ratio(part: Column, whole: Column, default: float) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(default)


def rates(results: DataFrame) -> DataFrame:
    """precision, recall and F1 of each fixture."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)
    return results.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def aggregate(results: DataFrame, *by: str) -> DataFrame:
    """Sums, precision, recall and noise over all results, or over each group."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "actual", "tp", "fp", "fn")]
    total = results.groupBy(*by).agg(*sums)
    return total.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), "noise": ratio(F.col("fp"), F.col("actual"), 0.0)})


def gates(metrics: DataFrame, inconclusive: Column | None = None) -> DataFrame:
    """Adds gates_passed: precision, recall and noise within bounds, nothing inconclusive."""
    passed = (F.col("precision") >= fixed.MIN_PRECISION) & (F.col("recall") >= fixed.MIN_RECALL) & (F.col("noise") <= fixed.MAX_NOISE)
    return metrics.withColumn("gates_passed", passed if inconclusive is None else passed & (inconclusive == 0))


def last_n(records: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The n latest records; partial limits run before the rows meet."""
    return records.orderBy(F.desc(order)).limit(n)


def trend(records: DataFrame, metrics: tuple[str, ...] = ("precision", "recall", "noise_rate"), n: int = fixed.HISTORY_WINDOW, order: str = "ord") -> DataFrame:
    """Newest minus oldest of each metric over the last n records, and how many there are."""
    return last_n(records, n, order).agg(F.count("*").alias("records"), *((F.max_by(m, order) - F.min_by(m, order)).alias(f"{m}_trend") for m in metrics))


def persistent_patterns(runs: DataFrame) -> DataFrame:
    """(name, runs, fp, fn, fp_persistent, fn_persistent) of rows (name, fp, fn), one for each run."""
    out = runs.groupBy("name").agg(F.count("*").alias("runs"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).where(F.col("runs") >= fixed.PATTERN_MIN_RUNS)
    out = out.withColumns({f"{c}_persistent": F.col(c) / F.col("runs") > fixed.PATTERN_RATIO for c in ("fp", "fn")})
    return out.where("fp_persistent OR fn_persistent")


def guidance(records: DataFrame, order: str = "ord") -> DataFrame:
    """One row with the advice that the history gives (an empty string for none)."""
    t = trend(records, order=order)
    rules = [
        F.when(F.col("precision_trend") < fixed.TREND_DECLINE, "precision declined: report only what has clear evidence"),
        F.when(F.col("precision_trend") > fixed.TREND_GAIN, "precision is strong: keep this rigor"),
        F.when(F.col("recall_trend") < fixed.TREND_DECLINE, "recall declined: look closer at errors, resources and edge cases"),
        F.when(F.col("recall_trend") > fixed.TREND_GAIN, "recall is strong"),
        F.when(F.col("noise_rate_trend") > fixed.TREND_NOISE, "noise is rising: leave out what is speculative"),
    ]
    advice = F.when(F.col("records") >= 2, F.array_join(F.array_compact(F.array(*rules)), "\n")).otherwise("")
    names = last_n(records, fixed.HISTORY_WINDOW, order).select(F.explode("per_fixture").alias("f")).select("f.name", "f.fp", F.col("f.fn_count").alias("fn"))
    p = persistent_patterns(names)

    def listed(flag: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col(flag), F.col("name"))))
        more = F.size(held) - fixed.PATTERN_NAMES
        return F.concat(F.array_join(F.slice(held, 1, fixed.PATTERN_NAMES), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))

    kept = p.agg(listed("fp_persistent").alias("noisy"), listed("fn_persistent").alias("missed"))
    return t.join(F.broadcast(kept)).select(advice.alias("advice"), "noisy", "missed")  # one row each


def regressions(records: DataFrame, order: str = "ord") -> DataFrame:
    """Each record against the one before: flags of worse precision, recall and noise."""
    w = Window.orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("precision", "recall", "noise_rate")}
    return records.select(
        order,
        (before["precision"] - F.col("precision") > fixed.PRECISION_DROP).alias("precision_drop"),
        (before["recall"] - F.col("recall") > fixed.RECALL_DROP).alias("recall_drop"),
        (F.col("noise_rate") - before["noise_rate"] > fixed.NOISE_RISE).alias("noise_rise"),
    )


def fixture_regressions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(name, what) of fixtures that lost a detection or gained false positives; of repeated names the last counts."""
    def last(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ord")))).where("_n = 1").drop("_n")

    both = last(current).alias("c").join(last(previous).alias("p"), "name")
    what = F.array_compact(F.array(F.when((F.col("p.tp") > 0) & (F.col("c.tp") == 0), "lost_detection"), F.when((F.col("p.fp") == 0) & (F.col("c.fp") > 0), "new_false_positive")))
    return both.select("name", F.explode(what).alias("what"))


#: Relative error of the sketch that brackets a percentile is 1 / SKETCH; a bracket reaches MARGIN errors to both sides.
SKETCH, MARGIN = 10_000, 3


def percentile_index(values: DataFrame, column: str, percents: tuple[int, ...], by: str) -> DataFrame:
    """The value at index ceil(n * p / 100), clamped, of each group's sorted values (one past the nearest rank); nulls don't count.

    No group is sorted. A sketch of each group brackets every wanted rank by two values; the rows below a bracket are counted,
    and only the values inside, some 2 * MARGIN / SKETCH of the group, are added up by value to find the one at the rank.
    """
    rows = values.select(F.col(by).alias("g"), F.col(column).alias("v")).where("v IS NOT NULL")
    wide = [x for p in percents for x in (max(0.0, p / 100 - MARGIN / SKETCH), min(1.0, p / 100 + MARGIN / SKETCH + 1e-9))]
    held = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", wide, SKETCH).alias("cut"))
    at = {p: F.least(F.ceil(F.col("n") * p / 100) + 1, F.col("n")) for p in percents}
    # a rank is one past the percentile's, so a small group's bracket reaches to its ends
    few = F.col("n") < 2 * SKETCH
    asked = F.array(*(F.struct(F.lit(p).alias("p"), at[p].cast("long").alias("rank"), F.when(few, F.col("least")).otherwise(F.col("cut")[2 * i]).alias("lo"), F.when(few, F.col("most")).otherwise(F.col("cut")[2 * i + 1]).alias("hi")) for i, p in enumerate(percents)))
    met = rows.join(held.select(F.col("g").alias("h"), asked.alias("asked")), F.col("g").eqNullSafe(F.col("h")))
    below = met.groupBy("g").agg(*(F.count_if(F.col("v") < F.col("asked")[i]["lo"]).alias(f"b{i}") for i in range(len(percents))))
    inside = met.select("g", "v", F.explode(F.filter("asked", lambda a: (F.col("v") >= a["lo"]) & (F.col("v") <= a["hi"]))).alias("a"))
    inside = inside.groupBy("g", F.col("a.p").alias("p"), F.col("a.rank").alias("rank"), "v").agg(F.count("*").alias("k"))
    started = below.select(F.col("g").alias("h"), F.explode(F.array(*(F.struct(F.lit(p).alias("q"), F.col(f"b{i}").alias("b")) for i, p in enumerate(percents)))).alias("s")).select("h", "s.q", "s.b")
    upto = F.sum("k").over(Window.partitionBy("g", "p").orderBy("v")) + F.col("b")
    found = inside.join(started, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("q"))).withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("k") < F.col("rank")))
    return found.groupBy(F.col("g").alias(by)).agg(*(F.max(F.when(F.col("p") == p, F.col("v"))).alias(f"p{p}") for p in percents))
