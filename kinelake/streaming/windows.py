"""Windows over streaming samples: epoch-aligned by Spark's own windows, segment-anchored by keyed state.

The anchored operator keeps, for each stream, its open segment: number, next
window's start, and the samples from that start on, which a window's length
bounds. It emits each window once a sample at or after its end has come, so its
results are those of the batch operator. Samples must arrive in order within a
stream; one that is earlier than the last seen is ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship


def epoch_windows(samples: DataFrame, event_time: str, width: str, slide: str, late: str, keys: tuple[str, ...] = ("subject",), value: str = "value") -> DataFrame:
    """Five statistics over sliding windows aligned to the epoch, final once the watermark has passed."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    rows = samples.withWatermark(event_time, late)
    return rows.groupBy(F.window(event_time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v * v).alias("energy"))


_OUT = "subject long, seg long, win long, start double, n long, mean double, std double, min double, max double, energy double"
_STATE = "seg long, win long, start double, last double, held binary"


def anchored_windows(samples: DataFrame, gap: float, length: float, overlap: float = 0.5, least: int = 1) -> DataFrame:
    """``samples``: subject long, t double, value double. One row a window, as the batch operators give it."""
    ship(samples.sparkSession)
    step = length * (1.0 - overlap)

    def per_stream(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            seg, win, start, last, raw = state.get
            held_t, held_v = pickle.loads(raw)
        else:
            seg, win, start, last, held_t, held_v = 0, 0, 0.0, float("-inf"), [], []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out: list[tuple] = []

        def emit() -> None:
            inside = np.array([v for t, v in zip(held_t, held_v, strict=True) if start <= t < start + length])
            if len(inside) >= least:
                out.append((key[0], seg, win, start, len(inside), inside.mean(), inside.std(), inside.min(), inside.max(), (inside * inside).mean()))

        def finish(until: float) -> None:
            """Windows that end at or before ``until``, the last time known of this segment."""
            nonlocal start, win, held_t, held_v
            while start + length <= until + 1e-9:
                emit()
                start, win = start + step, win + 1
                kept = [(t, v) for t, v in zip(held_t, held_v, strict=True) if t >= start]
                held_t, held_v = [t for t, _ in kept], [v for _, v in kept]

        for t, v in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True):
            if t < last:
                continue
            if t - last > gap:
                seg, win, start, held_t, held_v = seg + 1, 0, t, [], []
            held_t.append(t)
            held_v.append(v)
            last = t
            finish(t)
        state.update((seg, win, start, last, pickle.dumps((held_t, held_v))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    rows = samples.select(F.col("subject").cast("long").alias("subject"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("subject").applyInPandasWithState(per_stream, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
