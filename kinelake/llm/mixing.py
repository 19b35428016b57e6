"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each document gets a uniform number from a seeded hash of its identifier; the
inverse of the Poisson distribution with the source's mean repetition rate
turns it into a count, the document is exploded that often, and every copy goes
to a hashed place of a global shuffle. Rates need one count a source
(aggregated before the shuffle); a document is then handled alone, so that a
source with a third of all rows is spread over all tasks, and the copies of one
document never need each other.

Defined cases: a null source is a source of its own; a source without a target
weight (where weights are given) or with weight 0 or less contributes nothing;
a null text is allowed and a null identifier, too, whose row goes by its text
instead; empty and very long texts are rows like any other; repeated rows share
their count; an empty table gives an empty result; a name
that ``docs`` has already is never reused: ``copy_no``, ``n_copies`` and
``shuffle_key`` become ``copy_no_1`` and so on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free_name, materialise, table

#: Above so many numbers (8 MB) in all sources' distributions they are joined by a shuffle instead of a broadcast.
BROADCAST_NUMBERS = 1_000_000
SEED = 17
#: Above this rate a source's distribution begins near its mean instead of at 0.
DIRECT_RATE = 500.0


def uniform(key: Column, seed: int) -> Column:
    """52 bits of md5 as a double in [0, 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """(low, cdf): CDF(low), CDF(low + 1), ... up to where nothing is left in a double; built once a source, not once a row.

    Up to DIRECT_RATE low is 0. Beyond, exp(-rate) runs out of doubles: low lies
    12 deviations and 30 below the mean, where less than e ** -72 is before it, and its
    probability is taken in log space (Stirling's series, low being above 200).
    """
    far = rate > DIRECT_RATE
    margin = 12 * F.sqrt(rate) + 30
    low = F.when(far, F.floor(rate - margin)).otherwise(0).cast("int")
    k = F.when(far, low.cast("double")).otherwise(1.0)
    log_p = (k - rate) + k * F.log(rate / k) - 0.5 * F.log(2 * math.pi * k) - 1 / (12 * k) + 1 / (360 * k * k * k)
    p0 = F.exp(F.when(far, log_p).otherwise(-rate))
    start = F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    cdf = F.aggregate(F.sequence(low + 1, F.ceil(rate + margin).cast("int")), start, step, lambda acc: acc["all"])
    return F.struct(low.alias("low"), cdf.alias("cdf"))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, max_rate: float | None = None) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of as many rows as there are.

    Without ``weights`` the target share is n ** temperature, the usual
    temperature mix, whose rates grow with the table (by its square root, where a
    source is one row). Where a ``max_rate`` is given, rates from ``weights`` above it
    are refused, not clipped: a target that repeats one document more often is
    then taken for an error in the weights.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        target = F.coalesce(F.create_map(*pairs)[F.col("mix_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.select("mix_source", "n", F.greatest(target, F.lit(0.0)).alias("w"))
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.round(F.col("w") * F.col("all_n") / (F.col("all_w") * F.col("n")), 9)
    known = counts.where("w > 0").crossJoin(F.broadcast(total)).withColumn("rate", rate)  # total: one row
    if weights is None or max_rate is None:
        return known.select("mix_source", "rate")
    return known.select("mix_source", F.when(F.col("rate") <= max_rate, F.col("rate")).otherwise(F.raise_error(F.lit("a rate is above max_rate"))).alias("rate"))


def mix_sources(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = SEED, max_rate: float | None = None) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, globally shuffled, plus copy_no, n_copies and shuffle_key."""
    own = docs.columns
    origin, table_name, n, no, place = (free_name(x, own) for x in ("mix_source", "mix_cdf", "n_copies", "copy_no", "shuffle_key"))
    known = rates(docs, source_col, weights, temperature, max_rate)
    known = materialise(known.select(F.col("mix_source").alias(origin), poisson_cdf(F.col("rate")).alias(table_name)), "mix-rates")
    if (known.agg(F.sum(F.size(f"{table_name}.cdf") + 8)).first()[0] or 0) <= BROADCAST_NUMBERS:
        known = F.broadcast(known)
    rows = docs.join(known, F.col(source_col).cast("string").eqNullSafe(F.col(origin)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if text_col in own else F.lit("")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(text)))
    u = uniform(name, seed)
    rows = rows.withColumn(n, F.col(table_name)["low"] + F.size(F.filter(F.col(table_name)["cdf"], lambda c: c <= u))).where(F.col(n) > 0)
    copies = rows.withColumn(no, F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.md5(F.concat_ws("|", F.lit(f"place {seed}"), name, F.col(no).cast("string")))
    copies = copies.withColumn(place, key).drop(origin, table_name)
    return copies.repartition(place).sortWithinPartitions(place)


NAME = "op9_mix_sources"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH c AS (
  SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source
), r AS (
  SELECT source, round(w * (SELECT sum(n) FROM c) / ((SELECT sum(w) FROM c) * n), 9) AS rate FROM c
), f AS (
  WITH RECURSIVE s AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cum FROM r
    UNION ALL
    SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM s WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
  ) SELECT * FROM s
), u AS (
  SELECT *, CAST(('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents
), n AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, CAST(count(*) AS INTEGER) AS n_copies
  FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source AND f.cum <= u.u
  GROUP BY u.doc_id, u.text, u.lang, u.source, u.n_chars
), e AS (
  SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy_no FROM n
)
SELECT *, md5('place {SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) || '|' || copy_no) AS shuffle_key FROM e
"""
