"""Label distributions from token log-probabilities or votes, as column functions.

A distribution covers the whole label set: a label that no token named has
probability 0. Candidates are ``array<struct<token string, logprob double>>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_token(token: Column) -> Column:
    """' A', 'A\\n' and the sentence-piece form of a leading space all name 'A'."""
    spaced = F.translate(token, "▁", " ")
    return F.upper(F.regexp_replace(spaced, r"^\s+|\s+$", ""))


def logsumexp(values: Column) -> Column:
    """log of the sum of exponentials of an array; NULL for an empty one."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.when(F.size(values) > 0, top + F.log(total))


def softmax(values: Column) -> Column:
    """Probabilities of an array of log-weights, shifted by their maximum."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.transform(values, lambda v: F.exp(v - top) / total)


def label_logprobs(candidates: Column, labels: Sequence[str]) -> Column:
    """array<struct<label, logprob>> in label order; tokens that name one label are added up, absent labels have NULL."""

    def row(name: str) -> Column:
        own = F.filter(candidates, lambda c: label_token(c["token"]) == name.upper())
        return F.struct(F.lit(name).alias("label"), logsumexp(F.transform(own, lambda c: c["logprob"])).alias("logprob"))

    return F.array(*[row(name) for name in labels])


def distribution(logprobs: Column) -> Column:
    """array<struct<label, p>> over all labels from ``label_logprobs``; all NULL where no label was named."""
    seen = F.filter(F.transform(logprobs, lambda r: r["logprob"]), lambda v: v.isNotNull())
    whole = logsumexp(seen)
    return F.transform(
        logprobs,
        lambda r: F.struct(r["label"].alias("label"), F.when(whole.isNotNull(), F.coalesce(F.exp(r["logprob"] - whole), F.lit(0.0))).alias("p")),
    )


def vote_distribution(answers: Column, labels: Sequence[str]) -> Column:
    """array<struct<label, p>>: the share of each label among the answers whose first letter is a label."""
    firsts = F.transform(answers, lambda a: F.substring(label_token(a), 1, 1))
    valid = F.filter(firsts, lambda v: v.isin([x.upper() for x in labels]))
    n = F.size(valid)

    def row(name: str) -> Column:
        own = F.size(F.filter(valid, lambda v: v == name.upper()))
        return F.struct(F.lit(name).alias("label"), F.when(n > 0, own / n).alias("p"))

    return F.array(*[row(name) for name in labels])


def predicted(dist: Column) -> Column:
    """The likeliest label; of equals the one first in label order."""
    best = F.array_max(F.transform(dist, lambda r: r["p"]))
    return F.filter(dist, lambda r: r["p"] == best)[0]["label"]


def max_p(dist: Column) -> Column:
    return F.array_max(F.transform(dist, lambda r: r["p"]))


def log_margin(logprobs: Column) -> Column:
    """Distance between the two likeliest labels' log-probabilities; NULL with fewer than two."""
    ordered = F.sort_array(F.filter(F.transform(logprobs, lambda r: r["logprob"]), lambda v: v.isNotNull()), asc=False)
    return F.when(F.size(ordered) >= 2, F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))


def entropy(dist: Column) -> Column:
    """In nats; a label of probability 0 adds nothing."""
    return -F.aggregate(dist, F.lit(0.0), lambda acc, r: acc + F.when(r["p"] > 0, r["p"] * F.log(r["p"])).otherwise(F.when(r["p"].isNotNull(), 0.0)))


def slug(name: Column) -> Column:
    """A fragment for a folder name: letters, digits, dots, underscores and dashes stay, every other run is one dash."""
    made = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(made)
