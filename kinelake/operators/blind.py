"""The wall between the monitor and the ground truth.

Observed frames and truth are two tables from birth; what enters the monitor is
selected by an allow-list and asserted to hold nothing else. The names of columns don't settle
it: a truth column may be renamed, wrapped in a struct or a map, or computed with. So the
analysed plan is read, too, and a frame is refused when any of its columns comes from a truth
column, under whatever name. (Frames that a failure was written into are observations
again once they are stored; a stored table has no past.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OBSERVED = frozenset(
    {"dataset", "subject", "seg", "win", "start", "end", "node", "idx", "t", "ax", "ay", "az", "gx", "gy", "gz", "has_gyro", "rate_hz", "heart_rate", "ecg", "channels_present", "timestamp_derived"}
)
#: What a truth table calls its columns, and a window its label.
TRUTH = frozenset({"label", "failure", "severity", "target_node", "seed", "tag", "requested", "realised", "injection_stack", "clock_source", "true_failure", "expected_diagnosis", "is_target", "onset", "true_label"})


class GroundTruthError(TypeError):
    """A table with ground truth was given where only observations may be."""


def blind(frames: DataFrame) -> DataFrame:
    """The observed columns alone."""
    return frames.select(*[c for c in frames.columns if c in OBSERVED])


def _each(seq):
    """A Scala sequence's elements."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def column_sources(frames: DataFrame) -> list[tuple[str, frozenset[str]]]:
    """(column, names of all columns that it comes from, its own included), by the analysed plan.

    A step that is not understood (a Python function over groups, say) gives each of its new columns everything that it was given.
    """
    known: dict[int, frozenset[str]] = {}

    def number(attribute) -> int:
        return attribute.exprId().id()

    def names_of(expression) -> frozenset[str]:
        out: set[str] = set()
        for a in _each(expression.references().toSeq()):
            out |= known.get(number(a), frozenset()) | {a.name()}
        return frozenset(out)

    def visit(plan) -> None:
        children = list(_each(plan.children()))
        for child in children:
            visit(child)
        for e in _each(plan.expressions()):
            if e.nodeName() == "Alias":
                known[number(e)] = names_of(e) | {e.name()}
        given: frozenset[str] | None = None
        for i, a in enumerate(_each(plan.output())):
            if plan.nodeName() == "Union":
                own = frozenset().union(*[known.get(number(list(_each(c.output()))[i]), frozenset()) for c in children])
                known[number(a)] = known.get(number(a), frozenset()) | own | {a.name()}
            elif number(a) not in known:
                if given is None:
                    given = frozenset().union(*[known.get(number(x), frozenset()) | {x.name()} for c in children for x in _each(c.output())])
                if plan.nodeName() == "Generate":
                    known[number(a)] = names_of(plan.generator()) | {a.name()}
                else:
                    known[number(a)] = given | {a.name()}

    analysed = frames._jdf.queryExecution().analyzed()
    visit(analysed)
    return [(a.name(), known[number(a)]) for a in _each(analysed.output())]


def _may_hold_truth(frames: DataFrame) -> bool:
    """Whether any step of the plan has a column of such a name; spares the others the walk."""
    spark = frames.sparkSession
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        text = frames._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set(key, before)
    return any(f"{name}#" in text for name in TRUTH)


def require_blind(frames: DataFrame, where: str) -> DataFrame:
    """``frames`` itself, refused if it has a column that isn't an observation, by its name or by where it comes from."""
    extra = sorted(set(frames.columns) - OBSERVED)
    if extra:
        raise GroundTruthError(f"{where} takes blind frames; {extra} are not observations")
    if _may_hold_truth(frames):
        told = {column: sorted(names & TRUTH) for column, names in column_sources(frames) if names & TRUTH}
        if told:
            raise GroundTruthError(f"{where} takes blind frames; these columns come from the ground truth: {told}")
    return frames
