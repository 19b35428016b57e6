"""Fault models over frames, one strategy a failure, composable because each returns frames.

A strategy changes the rows of one node of every window and leaves all others
bit-identical; what it did is measured afterwards from the frames before and
after, into a truth table of its own. Draws are a function of (seed, window,
node, sample), so that they don't depend on the order or place of work, and
overlapping windows see different faults.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import ACCEL, GYRO, MOUNT_AXIS, NAN, all_nan, along_axis, angle, any_nan, known, mount_axis, norm
from ..session import ship
from . import NODE_KEY, WINDOW_KEY
from .hold import hold, sources

# What each severity from 1 to 4 means.
DROPPED_SHARE = (0.25, 0.50, 0.75, 1.0)
OFFSET_MS = (50.0, 200.0, 500.0, 2000.0)
LOSS_AND_BURST = ((0.05, 3.0), (0.15, 4.0), (0.30, 6.0), (0.50, 8.0))
DIVISOR = (2, 4, 8, 16)
TURN_DEG = (15.0, 30.0, 45.0, 90.0)


class InjectionError(ValueError):
    """The target lacks a channel, a node or a severity that the failure needs."""


def draw(seed: int, *extra: str) -> Column:
    """A uniform number in [0, 1) for each sample, by a seeded hash of its place."""
    h = F.xxhash64(F.lit(seed), *NODE_KEY, "idx", *[F.lit(x) for x in extra])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


class Strategy(ABC):
    """Subclass with ``name``, ``required``, ``params`` and ``change``, then ``register`` it."""

    name: str
    required: tuple[str, ...] = ("accel",)

    @abstractmethod
    def params(self, severity: int) -> dict[str, float]:
        """What a severity asks for."""

    @abstractmethod
    def change(self, target: DataFrame, severity: int, seed: int) -> DataFrame:
        """The target node's frames with the failure; same rows, same columns."""

    @abstractmethod
    def realised(self, before: DataFrame, after: DataFrame, severity: int) -> DataFrame:
        """WINDOW_KEY and a double for each measured effect."""


REGISTRY: dict[str, Strategy] = {}


def register(strategy: Strategy) -> Strategy:
    REGISTRY[strategy.name] = strategy
    return strategy


def blanked(lost: Column) -> dict[str, Column]:
    """Dropped samples: NaN on every axis that exists; an absent gyroscope stays absent."""
    accel = {c: F.when(lost, F.lit(NAN)).otherwise(F.col(c)) for c in ACCEL}
    return accel | {c: F.when(lost & F.col(c).isNotNull(), F.lit(NAN)).otherwise(F.col(c)) for c in GYRO}


class Dropout(Strategy):
    name = "dropout"

    def params(self, severity: int) -> dict[str, float]:
        return {"drop_fraction": DROPPED_SHARE[severity - 1]}

    def onset(self, severity: int) -> Column:
        return F.col("start") + (1.0 - DROPPED_SHARE[severity - 1]) * (F.col("end") - F.col("start"))

    def change(self, target, severity, seed):
        return target.withColumns(blanked(F.col("t") >= self.onset(severity) - 1e-12))

    def realised(self, before, after, severity):
        return after.groupBy(*WINDOW_KEY).agg(
            F.avg(all_nan().cast("double")).alias("frac_nan"),
            F.sum(all_nan().cast("double")).alias("n_blanked"),
            F.count(F.lit(1)).cast("double").alias("n_frames"),
            F.first(self.onset(severity)).alias("onset"),
            F.first(self.onset(severity) - F.col("start")).alias("onset_rel"),
        )


class ClockDesync(Strategy):
    name = "clock_desync"

    def __init__(self, skew_ppm: float = 0.0, per_second: float = 1.0):
        self.skew_ppm, self.per_second = skew_ppm, per_second

    def params(self, severity: int) -> dict[str, float]:
        return {"delta_ms": OFFSET_MS[severity - 1], "skew_ppm": self.skew_ppm}

    def change(self, target, severity, seed):
        shift = OFFSET_MS[severity - 1] / 1000.0 * self.per_second
        elapsed = F.col("t") - F.min("t").over(Window.partitionBy(*NODE_KEY)) if self.skew_ppm else F.lit(0.0)
        return target.withColumn("t", F.col("t") + shift + elapsed * (self.skew_ppm * 1e-6))

    def realised(self, before, after, severity):
        pair = before.select(*WINDOW_KEY, "idx", F.col("t").alias("t_before")).join(after.select(*WINDOW_KEY, "idx", "t"), [*WINDOW_KEY, "idx"])
        return pair.groupBy(*WINDOW_KEY).agg((F.avg(F.col("t") - F.col("t_before")) * (1000.0 / self.per_second)).alias("delta_ms"))


def transition_probabilities(loss, burst):
    """(good to bad, bad to good) of the two-state chain that loses ``loss`` of all samples in bursts of ``burst``."""
    return loss / ((1.0 - loss) * burst), 1.0 / burst


def bursty_loss(rows: DataFrame, loss: float | Column, burst: float | Column, u: Column, keys: Sequence[str] = NODE_KEY, order: Sequence[str] = ("idx",), out: str = "lost") -> DataFrame:
    """``rows`` with the chain's state (1 for lost) without walking it; ``loss`` and ``burst`` are the same in all of a chain.

    Each draw maps the state: it flips it, resets it to one of the two, or leaves it.
    The state is the last reset's value changed by the parity of the flips since. The
    first row resets to the stationary distribution.
    """
    loss, burst = (x if isinstance(x, Column) else F.lit(x) for x in (loss, burst))
    p, r = transition_probabilities(loss, burst)
    low, high = F.least(p, r), F.greatest(p, r)
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumn("ge_u", u).withColumn("ge_first", first)
    reset = F.col("ge_first") | ((F.col("ge_u") >= low) & (F.col("ge_u") < high))
    value = F.when(F.col("ge_first"), (F.col("ge_u") < loss).cast("int")).otherwise(F.when(p < r, 0).otherwise(1))
    rows = rows.withColumn("ge_reset", reset).withColumn("ge_value", F.when(reset, value)).withColumn("ge_flip", (~reset & (F.col("ge_u") < low)).cast("int"))
    rows = rows.withColumn("ge_run", F.sum(F.col("ge_reset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = Window.partitionBy(*keys, "ge_run").orderBy(*order)
    state = (F.first("ge_value").over(since) + F.sum("ge_flip").over(since.rowsBetween(Window.unboundedPreceding, 0))) % 2
    return rows.withColumn(out, state).drop("ge_u", "ge_first", "ge_reset", "ge_value", "ge_flip", "ge_run")


def burst_stats(rows: DataFrame, lost: Column, keys: Sequence[str] = WINDOW_KEY, order: Sequence[str] = ("idx",)) -> DataFrame:
    """keys, loss_rate, mean_burst, n_bursts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("is_lost", lost.cast("int"))
    begins = F.col("is_lost").cast("boolean") & (F.coalesce(F.lag("is_lost").over(w), F.lit(0)) == 0)
    per = marked.withColumn("begins", begins.cast("int")).groupBy(*keys).agg(F.avg("is_lost").alias("loss_rate"), F.sum("is_lost").alias("n_lost"), F.sum("begins").cast("double").alias("n_bursts"))
    return per.select(*keys, "loss_rate", F.when(F.col("n_bursts") > 0, F.col("n_lost") / F.col("n_bursts")).otherwise(0.0).alias("mean_burst"), "n_bursts")


def chunked_loss(rows: DataFrame, loss: float, burst: float, u: Column, chunk: Column, keys: Sequence[str] = NODE_KEY, order: Sequence[str] = ("idx",), out: str = "lost") -> DataFrame:
    """As ``bursty_loss`` for chains of any length: ``chunk`` rises with ``order``, and no task walks more than one chunk.

    What a chunk does to the state is a map of two states: it sets it, turns it or keeps it. The maps
    of a chain's chunks (a row each) are composed in order, which gives the state that each begins with.
    """
    p, r = transition_probabilities(loss, burst)
    own = [*keys, "ge_chunk"]
    rows = rows.withColumns({"ge_chunk": chunk, "ge_u": u})
    w = Window.partitionBy(*own).orderBy(*order)
    rows = rows.withColumn("ge_head", F.row_number().over(w) == 1)
    # A chunk's first row is told apart: the chain's first row sets the state by itself.
    resets = (F.col("ge_u") >= min(p, r)) & (F.col("ge_u") < max(p, r))
    value, flips = F.lit(0 if p < r else 1), (F.col("ge_u") < min(p, r)).cast("int")
    rows = rows.withColumns({"ge_reset": (~F.col("ge_head") & resets).cast("long"), "ge_flip": F.when(F.col("ge_head"), 0).otherwise(flips)})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ge_run", F.sum("ge_reset").over(upto))
    since = Window.partitionBy(*own, "ge_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ge_turn", F.sum("ge_flip").over(since) % 2)
    per = rows.groupBy(*own).agg(
        F.max(F.when(F.col("ge_head"), F.col("ge_u"))).alias("u"),
        F.max_by(F.struct("ge_run", "ge_turn"), F.struct(*order)).alias("last"),
    )
    chain = Window.partitionBy(*keys).orderBy("ge_chunk")
    first = F.row_number().over(chain) == 1
    head_resets, head_flips = (F.col("u") >= min(p, r)) & (F.col("u") < max(p, r)), (F.col("u") < min(p, r)).cast("int")
    sets = first | (F.col("last.ge_run") > 0) | head_resets
    set_to = F.when(F.col("last.ge_run") > 0, (value + F.col("last.ge_turn")) % 2).otherwise((F.when(first, (F.col("u") < loss).cast("int")).otherwise(value) + F.col("last.ge_turn")) % 2)
    per = per.withColumns({"first": first, "sets": sets, "set_to": F.when(sets, set_to), "turns": F.when(sets, 0).otherwise((head_flips + F.col("last.ge_turn")) % 2)})
    per = per.withColumn("run", F.sum(F.col("sets").cast("long")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    since_set = Window.partitionBy(*keys, "run").orderBy("ge_chunk").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("ends", (F.first("set_to").over(since_set) + F.sum("turns").over(since_set)) % 2)
    begins = F.when(F.col("first"), (F.col("u") < loss).cast("int")).when(head_resets, value).otherwise((F.lag("ends").over(chain) + head_flips) % 2)
    per = per.select(*own, begins.alias("ge_begins"))
    state = F.when(F.col("ge_run") > 0, (value + F.col("ge_turn")) % 2).otherwise((F.col("ge_begins") + F.col("ge_turn")) % 2)
    return rows.join(per, own).withColumn(out, state).drop("ge_chunk", "ge_u", "ge_head", "ge_reset", "ge_flip", "ge_run", "ge_turn", "ge_begins")


def chunked_burst_stats(rows: DataFrame, lost: Column, chunk: Column, keys: Sequence[str] = WINDOW_KEY, order: Sequence[str] = ("idx",)) -> DataFrame:
    """As ``burst_stats``: bursts are counted in chunks, and one that goes on over a border counts once."""
    own = [*keys, "ge_chunk"]
    marked = rows.withColumns({"ge_chunk": chunk, "is_lost": lost.cast("int")})
    before = F.lag("is_lost").over(Window.partitionBy(*own).orderBy(*order))
    marked = marked.withColumn("begins", ((F.col("is_lost") == 1) & (F.coalesce(before, F.lit(0)) == 0)).cast("int"))
    per = marked.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum("is_lost").alias("n_lost"), F.sum("begins").alias("n_begins"), F.min_by("is_lost", F.struct(*order)).alias("head"), F.max_by("is_lost", F.struct(*order)).alias("tail"))
    goes_on = F.col("head") * F.coalesce(F.lag("tail").over(Window.partitionBy(*keys).orderBy("ge_chunk")), F.lit(0))
    per = per.withColumn("n_begins", F.col("n_begins") - goes_on).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_lost").alias("n_lost"), F.sum("n_begins").cast("double").alias("n_bursts"))
    return per.select(*keys, (F.col("n_lost") / F.col("n")).alias("loss_rate"), F.when(F.col("n_bursts") > 0, F.col("n_lost") / F.col("n_bursts")).otherwise(0.0).alias("mean_burst"), "n_bursts")


class PacketLoss(Strategy):
    name = "packet_loss"

    def __init__(self, uniform: Column | None = None):
        self.uniform = uniform

    def params(self, severity: int) -> dict[str, float]:
        loss, burst = LOSS_AND_BURST[severity - 1]
        p, r = transition_probabilities(loss, burst)
        return {"target_loss_rate": loss, "target_mean_burst": burst, "p_good_to_bad": p, "r_bad_to_good": r}

    def change(self, target, severity, seed):
        u = self.uniform if self.uniform is not None else draw(seed, self.name)
        return bursty_loss(target, *LOSS_AND_BURST[severity - 1], u).withColumns(blanked(F.col("lost") == 1)).drop("lost")

    def realised(self, before, after, severity):
        return burst_stats(after, all_nan())


def numpy_draws(target: DataFrame, seed: int) -> DataFrame:
    """``target`` with ``u``: the numbers that one numpy generator with this seed draws when it walks all
    windows in stream order, one before each window and one after each sample.

    Every window finds its own place in the generator's sequence (the samples and windows
    before it, summed by subject and then inside a subject), so the work is not ordered.
    """
    ship(target.sparkSession)
    per = target.groupBy(*WINDOW_KEY).agg((F.count(F.lit(1)) + 1).alias("used"))
    subjects = per.groupBy("dataset", "subject").agg(F.sum("used").alias("all_used"))
    before_subject = F.sum("all_used").over(Window.partitionBy("dataset").orderBy("subject")) - F.col("all_used")  # a row a subject
    subjects = subjects.select("dataset", "subject", before_subject.alias("base"))
    inside = F.sum("used").over(Window.partitionBy("dataset", "subject").orderBy("seg", "win")) - F.col("used")
    places = per.withColumn("inside", inside).join(subjects, ["dataset", "subject"]).select(*WINDOW_KEY, (F.col("base") + F.col("inside")).alias("offset"), "used")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema.fields if f.name in WINDOW_KEY)

    def task(batches):
        import numpy as np

        for pdf in batches:
            draws = [np.random.Generator(np.random.PCG64(seed).advance(int(o))).random(int(n)) for o, n in zip(pdf["offset"], pdf["used"], strict=True)]
            yield pdf[list(WINDOW_KEY)].assign(draws=draws)

    drawn = places.mapInPandas(task, f"{kinds}, draws array<double>")
    return target.join(drawn, list(WINDOW_KEY)).withColumn("u", F.element_at("draws", F.col("idx"))).drop("draws")


class NumpyPacketLoss(PacketLoss):
    """Packet loss with numpy's numbers, for results that must equal a sequential run's bit for bit."""

    def change(self, target, severity, seed):
        rows = numpy_draws(target, seed)
        return bursty_loss(rows, *LOSS_AND_BURST[severity - 1], F.col("u")).withColumns(blanked(F.col("lost") == 1)).drop("lost", "u")


class RateDegradation(Strategy):
    """Sample and hold: a value is taken over once a period has passed since the last one, in between it repeats."""

    name = "rate_degradation"

    def __init__(self, rate_hz: float, per_second: float = 1.0):
        self.rate_hz, self.per_second = rate_hz, per_second

    def params(self, severity: int) -> dict[str, float]:
        return {"divisor": float(DIVISOR[severity - 1])}

    def period(self, severity: int) -> float:
        return DIVISOR[severity - 1] / self.rate_hz * self.per_second

    @staticmethod
    def shown(held: DataFrame) -> DataFrame:
        # A held gyroscope reading never replaces an absent one, nor an absent one a reading.
        gyro = {c: F.when(F.col(c).isNotNull() & F.col(f"held_{c}").isNotNull(), F.col(f"held_{c}")).otherwise(F.col(c)) for c in GYRO}
        return held.withColumns({c: F.col(f"held_{c}") for c in ACCEL} | gyro)

    def change(self, target, severity, seed):
        return self.shown(hold(target, self.period(severity))).select(*target.columns)

    def realised(self, before, after, severity):
        taken = sources(before, self.period(severity)).where("idx = source").groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).cast("double").alias("n_holds"))
        per = before.groupBy(*WINDOW_KEY).agg((F.max("t") - F.min("t")).alias("span")).join(taken, list(WINDOW_KEY))
        hz = F.when(F.col("span") > 0, F.col("n_holds") * self.per_second / F.col("span")).otherwise(0.0)
        return per.select(*WINDOW_KEY, F.lit(self.rate_hz / DIVISOR[severity - 1]).alias("target_hz"), hz.alias("realised_hz"), "n_holds")


def rotated(names: Sequence[str], axis: int, theta_deg: float) -> dict[str, Column]:
    """The vector turned right-handedly by ``theta`` about a principal axis; NaN and NULL pass through."""
    c, s = math.cos(math.radians(theta_deg)), math.sin(math.radians(theta_deg))
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    a, b = F.col(names[i]), F.col(names[j])
    return {names[i]: a * c - b * s, names[j]: a * s + b * c}


def mean_direction(frames: DataFrame, keys: Sequence[str], blank: Column) -> DataFrame:
    """keys and the mean vector mx, my, mz over samples that are not blank."""
    return frames.groupBy(*keys).agg(*[F.avg(F.when(~blank, F.col(c))).alias(m) for c, m in zip(ACCEL, ("mx", "my", "mz"), strict=True)])


class Displacement(Strategy):
    """The sensor has turned about the limb's long axis."""

    name = "displacement"

    def __init__(self, axis: int | None = None):
        self.axis = axis

    def params(self, severity: int) -> dict[str, float]:
        return {"theta_deg": TURN_DEG[severity - 1]}

    def _per_axis(self, node: Column, make) -> dict[str, Column]:
        """The same columns for whichever axis the row's node turns about."""
        out: dict[str, Column] = {}
        axis = F.lit(self.axis) if self.axis is not None else None
        for c in (*ACCEL, *GYRO):
            value = F.col(c)
            for k in range(3):
                here = (axis == k) if axis is not None else node.isin([n for n, a in MOUNT_AXIS.items() if a == k]) | (F.lit(k == 0) & ~node.isin(list(MOUNT_AXIS)))
                value = F.when(here, make(k).get(c, F.col(c))).otherwise(value)
            out[c] = value
        return out

    def change(self, target, severity, seed):
        theta = TURN_DEG[severity - 1]
        return target.withColumns(self._per_axis(F.col("node"), lambda k: rotated(ACCEL, k, theta) | rotated(GYRO, k, theta)))

    def realised(self, before, after, severity):
        names = ["mx", "my", "mz"]
        a = mean_direction(before, [*WINDOW_KEY, "node"], all_nan())
        b = mean_direction(after, WINDOW_KEY, all_nan()).withColumnsRenamed({n: f"{n}_after" for n in names})
        both = a.join(b, list(WINDOW_KEY))
        before_v = [F.col(n) for n in names]
        turned = F.coalesce(angle(before_v, [F.col(f"{n}_after") for n in names]), F.lit(0.0))
        length = norm(*before_v)
        part = along_axis(F.col("node"), before_v) if self.axis is None else before_v[self.axis]
        return both.select(*WINDOW_KEY, turned.alias("realised_angle_deg"), F.when(length > 1e-12, F.abs(part) / length).alias("gravity_axis_alignment"))


for _made in (Dropout(), ClockDesync(), PacketLoss(), Displacement()):
    register(_made)

FAILURE_TYPES = ("dropout", "clock_desync", "packet_loss", "rate_degradation", "displacement")
#: The measured effect that stands for a failure's size.
REALISED_KEY = {"dropout": "frac_nan", "clock_desync": "delta_ms", "packet_loss": "loss_rate", "rate_degradation": "realised_hz", "displacement": "realised_angle_deg"}


def strategy_for(failure: str, rate_hz: float | None = None) -> Strategy:
    if failure in REGISTRY:
        return REGISTRY[failure]
    if failure == RateDegradation.name:
        if not rate_hz:
            raise InjectionError("rate_degradation needs the sampling rate")
        return RateDegradation(rate_hz)
    raise InjectionError(f"no failure {failure!r}; there are {sorted({*FAILURE_TYPES, *REGISTRY})}")


def check_capability(frames: DataFrame, strategy: Strategy, target_node: str, severity: int) -> None:
    """Refuses a severity, node or channel that isn't there, before any work is planned."""
    if severity not in (1, 2, 3, 4):
        raise InjectionError(f"severity {severity!r}; it is 1, 2, 3 or 4")
    sample = frames.where(F.col("node") == target_node).select("has_gyro").limit(1).collect()
    if not sample:
        raise InjectionError(f"no node {target_node!r} in the windows")
    if "gyro" in strategy.required and not sample[0]["has_gyro"]:
        raise InjectionError(f"{strategy.name} needs a gyroscope on {target_node!r}")


def inject(frames: DataFrame, failure: str | Strategy, severity: int, target_node: str, seed: int = 0, rate_hz: float | None = None, checked: bool = True) -> tuple[DataFrame, DataFrame]:
    """(frames with the failure, truth). Compose by passing the frames of one call to the next."""
    strategy = failure if isinstance(failure, Strategy) else strategy_for(failure, rate_hz)
    if checked:
        check_capability(frames, strategy, target_node, severity)
    target = frames.where(F.col("node") == target_node)
    after = strategy.change(target, severity, seed).select(*frames.columns)
    changed = frames.where(F.col("node") != target_node).unionByName(after)
    measured = strategy.realised(target, after, severity)
    effects = [c for c in measured.columns if c not in WINDOW_KEY]
    as_map = F.map_from_arrays(F.array(*[F.lit(c) for c in effects]), F.array(*[F.col(c).cast("double") for c in effects]))
    asked = strategy.params(severity)
    truth = measured.select(
        *WINDOW_KEY,
        F.lit(target_node).alias("target_node"),
        F.lit(strategy.name).alias("failure"),
        F.lit(severity).alias("severity"),
        F.lit(seed).alias("seed"),
        F.lit(f"{strategy.name}:sev{severity}").alias("tag"),
        F.create_map(*[x for k, v in asked.items() for x in (F.lit(k), F.lit(float(v)))]).alias("requested"),
        as_map.alias("realised"),
    )
    return changed, truth


def stacked(*truths: DataFrame) -> DataFrame:
    """WINDOW_KEY and the tags of every applied failure, in the order of application."""
    rows = None
    for i, t in enumerate(truths):
        part = t.select(*WINDOW_KEY, F.struct(F.lit(i).alias("step"), "tag").alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*WINDOW_KEY).agg(F.sort_array(F.collect_list("s")).alias("s")).select(*WINDOW_KEY, F.col("s.tag").alias("injection_stack"))


def sweep_table(failures: Sequence[str] = FAILURE_TYPES) -> list[tuple[str, int]]:
    """Every failure with every severity: the 20 conditions of an evaluation."""
    return [(f, s) for f in failures for s in (1, 2, 3, 4)]


def sweep(windows: DataFrame, failures: Sequence[str] = FAILURE_TYPES) -> DataFrame:
    """``windows`` once for each condition, with failure and severity (20 literal rows, exploded in place)."""
    conditions = F.array(*[F.struct(F.lit(f).alias("failure"), F.lit(s).alias("severity")) for f, s in sweep_table(failures)])
    return windows.withColumn("condition", F.explode(conditions)).select(*windows.columns, "condition.failure", "condition.severity")


def swept(rows: DataFrame, u: Column, rate_hz: float, per_second: float = 1.0) -> DataFrame:
    """The target node's frames, each under the failure and severity of its own columns ``failure`` and ``severity``.

    The failures are expressions over these two columns, so that a sweep is one pass over the frames
    instead of one a condition. What each does is what its ``Strategy`` does; ``u`` are the draws of packet loss.
    A window's rows under different conditions must differ in WINDOW_KEY.
    """

    def of(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("severity"))

    def when(failure: str, change: Column, column: str) -> Column:
        return F.when(F.col("failure") == failure, change).otherwise(F.col(column))

    def kept(out: DataFrame) -> DataFrame:
        return out.select(*rows.columns)

    onset = F.col("start") + (1.0 - of(DROPPED_SHARE)) * (F.col("end") - F.col("start"))
    changes = {c: when("dropout", x, c) for c, x in blanked(F.col("t") >= onset - 1e-12).items()}
    changes["t"] = when("clock_desync", F.col("t") + of([ms / 1000.0 * per_second for ms in OFFSET_MS]), "t")
    theta = F.radians(of(TURN_DEG))
    axis = mount_axis(F.col("node"))
    for names in (ACCEL, GYRO):
        for i, c in enumerate(names):
            # About axis k, the axis after k takes cos and -sin, the one after that sin and cos.
            after, before = F.col(names[(i + 1) % 3]), F.col(names[(i + 2) % 3])
            turned = F.when(axis == i, F.col(c)).when(axis == (i + 2) % 3, F.col(c) * F.cos(theta) - after * F.sin(theta)).otherwise(before * F.sin(theta) + F.col(c) * F.cos(theta))
            changes[c] = F.when(F.col("failure") == "displacement", turned).otherwise(changes[c])
    plain = kept(rows.where(F.col("failure").isin("dropout", "clock_desync", "displacement")).withColumns(changes))
    chains = bursty_loss(rows.where(F.col("failure") == "packet_loss"), of([x for x, _ in LOSS_AND_BURST]), of([x for _, x in LOSS_AND_BURST]), u)
    lossy = kept(chains.withColumns(blanked(F.col("lost") == 1)))
    slow = RateDegradation(rate_hz, per_second)
    held = hold(rows.where(F.col("failure") == slow.name), of([slow.period(s) for s in (1, 2, 3, 4)]))
    return plain.unionByName(lossy).unionByName(kept(slow.shown(held)))


def inject_swept(frames: DataFrame, target_node: str, u: Column, rate_hz: float, per_second: float = 1.0) -> DataFrame:
    """``inject`` for frames that are there once a condition (columns as in ``swept``): the target's rows swept, the others' as they are."""
    own = F.col("node") == target_node
    return frames.where(~own).unionByName(swept(frames.where(own), u, rate_hz, per_second))


def untouched(before: DataFrame, after: DataFrame, target_node: str) -> DataFrame:
    """Rows of other nodes that an injection changed: empty if all is well. NaN and NULL compare null-safely."""
    a = before.where(F.col("node") != target_node)
    b = after.where(F.col("node") != target_node)
    return a.exceptAll(b.select(*a.columns)).unionByName(b.select(*a.columns).exceptAll(a))


def fingerprint(columns: Sequence[str] = ("idx", "t", *ACCEL, *GYRO)) -> Column:
    """A 64-bit hash of a row that tells numbers, NaN and NULL apart."""
    parts = []
    for c in columns:
        value = F.col(c).cast("double")
        parts += [F.when(value.isNull(), 2).when(F.isnan(value), 1).otherwise(0), F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))]
    return F.xxhash64(*parts)


def window_sums(frames: DataFrame, target_node: str, keys: Sequence[str] = WINDOW_KEY) -> DataFrame:
    """One row a window: the rows of the target and of the others as sums that don't depend on their order.

    Two multisets of rows with one sum of fingerprints are alike, but for a chance of about one in 10^19.
    """
    target = F.col("node") == target_node
    row = fingerprint()
    hashed = F.col("hash").cast("decimal(20,0)")
    nulls = sum((F.col(c).isNull().cast("long") for c in (*ACCEL, *GYRO)), F.lit(0))
    named = F.xxhash64(F.lit("node"), "node")  # the others' rows are told apart by their node, too
    rows = frames.withColumns({"target": target, "hash": F.when(target, row).otherwise(row.bitwiseXOR(named)), "vec": fingerprint(ACCEL)})
    own = lambda c: F.when(F.col("target"), c)
    return rows.groupBy(*keys).agg(
        F.sum(F.when(~F.col("target"), hashed)).alias("others"),
        F.sum(own(hashed)).alias("own"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(own(F.lit(1))).alias("n_own"),
        F.sum(nulls).alias("n_null"),
        F.sum(own(any_nan().cast("long"))).alias("n_nan"),
        F.count_distinct(own(F.col("vec"))).alias("n_values"),
        F.sum(own(F.col("t"))).alias("t_sum"),
        *[F.sum(own(F.when(~all_nan(), F.col(c)))).alias(f"{c}_sum") for c in ACCEL],
    )


def invariants(before: DataFrame, after: DataFrame, per_second: float = 1.0, by: Sequence[str] = ("failure", "severity")) -> DataFrame:
    """One row a failure and severity: what every injection must keep and do.

    ``before`` and ``after`` are ``window_sums``; ``after`` has ``by``, too. n_windows; untouched: the others' rows are the
    same in every window; n_made and n_nulls: rows and NULLs that came or went; n_nan: samples that became missing;
    changed: the share of windows whose target rows differ; effect: lost samples, milliseconds, repeated
    values or degrees, as the failure has it, a window; monotone: no less than the severity below.
    """
    sums = ("others", "own", "n_rows", "n_null", "n_nan", "n_values", "t_sum", *[f"{c}_sum" for c in ACCEL])
    both = after.join(before.select(*WINDOW_KEY, *[F.col(c).alias(f"{c}_before") for c in sums]), list(WINDOW_KEY)).where(F.col("n_own") > 0)
    was = lambda c: F.col(f"{c}_before")
    turned = angle([was(f"{c}_sum") for c in ACCEL], [F.col(f"{c}_sum") for c in ACCEL])
    effect = (
        F.when(F.col("failure") == "clock_desync", (F.col("t_sum") - was("t_sum")) / F.col("n_own") * (1000.0 / per_second))
        .when(F.col("failure") == "rate_degradation", (was("n_values") - F.col("n_values")).cast("double"))
        .when(F.col("failure") == "displacement", F.nanvl(F.coalesce(turned, F.lit(0.0)), F.lit(None)))  # a window without a direction has not turned
        .otherwise((F.col("n_nan") - was("n_nan")).cast("double"))
    )
    per = both.withColumn("effect", effect).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.bool_and(F.col("others").eqNullSafe(was("others"))).alias("untouched"),
        F.sum(F.col("n_rows") - was("n_rows")).alias("n_made"),
        F.sum(F.col("n_null") - was("n_null")).alias("n_nulls"),
        F.sum(F.col("n_nan") - was("n_nan")).alias("n_nan"),
        F.avg((~F.col("own").eqNullSafe(was("own"))).cast("double")).alias("changed"),
        F.avg("effect").alias("effect"),
    )
    below = F.lag("effect").over(Window.partitionBy("failure").orderBy("severity"))  # a row a severity
    return per.withColumn("monotone", F.coalesce(F.col("effect") >= below - 1e-9, F.lit(True)))


def missing_share(frames: DataFrame) -> DataFrame:
    """NODE_KEY and the share of missing samples."""
    return frames.groupBy(*NODE_KEY).agg(F.avg(any_nan().cast("double")).alias("nan_fraction"), F.count(known("ax")).alias("n_known"))
