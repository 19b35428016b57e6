"""Detection latency over a stream of verdicts (an extension: the surveyed code has no streams).

For each (stream, failure, severity, target) the first flagged window that ends at or after
the onset, as ``score.detection_latency`` gives it. Verdicts may come in any order up to
the watermark; one whose window ends before the watermark is late and ignored.

State, a key: the earliest onset, and the ends of flagged windows that may still be the
answer. No verdict that is yet to come has an onset earlier than the watermark less a
window's width, which bounds what is held. A timer answers once nothing to come can
change the answer; a failure that nobody has flagged is reported as not
detected once ``patience`` has passed since its onset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

KEYS = ("dataset", "subject", "true_failure", "severity", "node")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latency(StatefulProcessor):
    def __init__(self, width: float, patience: float, ms_per_unit: float):
        self.width, self.patience, self.scale = width, patience, ms_per_unit

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "onset double, ends array<double>, done boolean")

    def _answer(self, onset: float, ends: list[float]) -> float | None:
        return min((e for e in ends if e >= onset), default=None)

    def _wait(self, onset: float, ends: list[float]) -> None:
        """One timer: when the answer is beyond doubt, or patience ends."""
        found = self._answer(onset, ends)
        due = min(onset + self.patience, found + self.width) if found is not None else onset + self.patience
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max(1, int(due * self.scale) + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        onset, ends, done = self.seen.get() if self.seen.exists() else (None, [], False)
        if not done:
            mark = timerValues.getCurrentWatermarkInMs() / self.scale
            ends = list(ends)
            for batch in rows:
                fresh = batch[batch["end"] >= mark]
                if len(fresh):
                    first = float(fresh["onset"].min())
                    onset = first if onset is None else min(onset, first)
                    ends += fresh.loc[fresh["flagged"], "end"].astype(float).tolist()
            if onset is not None:
                found = self._answer(onset, ends)
                low = min(onset, mark - self.width)
                ends = sorted({e for e in ends if e >= low and (found is None or e <= found)})
                self.seen.update((onset, ends, False))
                self._wait(onset, ends)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        onset, ends, done = self.seen.get()
        if not done:
            found = self._answer(onset, list(ends))
            self.seen.update((onset, [], True))
            yield pd.DataFrame([(*key, onset, found)], columns=[*KEYS, "onset", "detected_by"])

    def close(self) -> None:
        pass


def latency_stream(rows: DataFrame, width: float, patience: float, late: str, ms_per_unit: float = 1000.0, per_second: float = 1.0) -> DataFrame:
    """``rows`` is a stream of scored verdicts (KEYS, end, onset, flagged, is_target); times are numbers of ``ms_per_unit`` milliseconds.

    ``width`` is a window's length, ``late`` how far behind the latest verdict one may come.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    target = rows.where("is_target and onset is not null").withColumn("ts", F.timestamp_millis((F.col("end") * ms_per_unit).cast("long")))
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", onset double, detected_by double"
    marked = target.withWatermark("ts", late).select(*KEYS, "end", "onset", "flagged", "ts").groupBy(*KEYS)
    found = marked.transformWithStateInPandas(Latency(width, patience, ms_per_unit), out, "append", "eventtime")
    behind = F.greatest(F.lit(0.0), F.col("detected_by") - F.col("onset")) / per_second
    return found.withColumn("latency_sec", F.when(F.col("detected_by").isNotNull(), behind))
