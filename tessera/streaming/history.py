"""The evaluation history as a stateful stream: each record against the one before it, and the trend of the last n, as records come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera import fixed

METRICS = ("precision", "recall", "noise_rate")
#: A record in the state: its time in milliseconds, its commit, its metrics.
HELD = "at long, sha string, precision double, recall double, noise_rate double"
CHANGES = "series string, ts timestamp, git_sha string, precision_drop boolean, recall_drop boolean, noise_rise boolean, records long, precision_trend double, recall_trend double, noise_rate_trend double"
#: The state store that stateful processors need; set it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Held = tuple[int, str | None, float, float, float]


def change(before: list[Held], now: Held) -> tuple:
    """Flags of worse metrics against the last of `before` (null without one), and the trend over these and `now`."""
    values = dict(zip(METRICS, now[2:], strict=True))
    flags: list[bool | None] = [None] * 3
    if before:
        last = dict(zip(METRICS, before[-1][2:], strict=True))
        flags = [last["precision"] - values["precision"] > fixed.PRECISION_DROP, last["recall"] - values["recall"] > fixed.RECALL_DROP, values["noise_rate"] - last["noise_rate"] > fixed.NOISE_RISE]
    first = before[0] if before else now
    return (*flags, len(before) + 1, *(new - old for new, old in zip(now[2:], first[2:], strict=True)))


class Changes(StatefulProcessor):
    """State of a series: records that wait for their turn, and the last n that had theirs.

    A record waits until the watermark has passed its time, so records that come late, but not too late, take their place in
    order; what the watermark has left behind is dropped by Spark.
    """

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", HELD)
        self.last = handle.getListState("last", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new: list[Held] = []
        for pdf in rows:
            new += [(int(r.at), r.sha, float(r.precision), float(r.recall), float(r.noise_rate)) for r in pdf.itertuples(index=False)]
        if new:
            self.waiting.appendList(new)
            for at in {r[0] for r in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] or "", r[2:]))
        turn, later = [r for r in held if r[0] <= due], [r for r in held if r[0] > due]
        if not turn:
            yield pd.DataFrame()
            return
        before: list[Held] = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        out = []
        for record in turn:
            before = before[-(self.n - 1) :] if self.n > 1 else []
            out.append((key[0], pd.Timestamp(record[0], unit="ms"), record[1], *change(before, record)))
            before.append(record)
        self.last.put(before)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in CHANGES.split(",")])

    def close(self) -> None:
        pass


def changes(records: DataFrame, late: str = "2 days", n: int = fixed.HISTORY_WINDOW, series: str | None = None) -> DataFrame:
    """CHANGES rows of a stream of records (ts, git_sha, precision, recall, noise_rate, and a column `series` if named).

    The rows are those that evaluate.regressions() and evaluate.trend() give for the same records in one batch, however the
    stream is cut into micro-batches and wherever it is taken up again from its checkpoint. A record comes out once the
    watermark (the greatest time seen less `late`) has passed it. Series are independent of each other. Records without
    a time or with a null metric are left out. Needs PROVIDER as the state store.
    """
    whole = records.where(F.col("ts").isNotNull() & F.col("precision").isNotNull() & F.col("recall").isNotNull() & F.col("noise_rate").isNotNull())
    rows = whole.withWatermark("ts", late).select((F.col(series) if series else F.lit("")).cast("string").alias("series"), "ts", F.unix_millis("ts").alias("at"), F.col("git_sha").alias("sha"), *METRICS)
    return rows.groupBy("series").transformWithStateInPandas(Changes(n), CHANGES, "append", "eventTime")
