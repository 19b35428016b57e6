import math

import pytest
from pyspark.sql import functions as F

from kinelake.llm.mixing import mix_sources, poisson_cdf, rates, uniform

from .helpers import awkward, docs


def test_counts_are_the_inverted_poisson(spark):
    rows = [(i, f"t{i}", "big" if i % 4 else "small") for i in range(2000)]
    df = docs(spark, rows)
    known = {r["mix_source"]: r["rate"] for r in rates(df, "source", None, 0.5, 500.0).collect()}
    assert known["small"] > 1 > known["big"]
    got = {}
    for r in mix_sources(df).select("doc_id", "n_copies", "copy_no").collect():
        got.setdefault(r["doc_id"], []).append((r["n_copies"], r["copy_no"]))
    from pyspark.sql import functions as F

    for r in df.select("doc_id", "source", uniform(F.col("doc_id").cast("string"), 17).alias("u")).collect():
        rate = known[r["source"]]
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= r["u"]:
            k += 1
            p *= rate / k
            c += p
        assert sorted(got.get(r["doc_id"], [])) == [(k, j) for j in range(1, k + 1)]


def test_shares_near_their_targets(spark):
    df = docs(spark, [(i, "t", "ab"[i % 10 == 0]) for i in range(6000)])
    out = {r["source"]: r["count"] for r in mix_sources(df, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(out["a"] - 3000) < 5 * 55 and abs(out["b"] - 3000) < 5 * math.sqrt(3000 * 6)


def test_null_sources_clashing_names_and_zero_weights(spark):
    df = spark.createDataFrame([(1, "x", None, 9), (2, "y", "a", 8), (None, None, "a", 7)], "doc_id long, text string, source string, n_copies int")
    out = mix_sources(df)
    assert out.columns[:4] == df.columns and out.columns[4:] == ["n_copies_1", "copy_no", "shuffle_key"]
    assert mix_sources(df, weights={"b": 1.0}).count() == 0
    assert mix_sources(df.limit(0)).count() == 0
    assert {r["source"] for r in mix_sources(df, weights={"a": 1.0}, seed=1).collect()} <= {"a"}


def test_same_seed_same_rows(spark):
    df = docs(spark, [(i, "t", "abc"[i % 3]) for i in range(300)])
    a, b = (sorted(map(tuple, mix_sources(df.repartition(n)).select("doc_id", "copy_no").collect())) for n in (2, 5))
    assert a == b


def test_wild_rates_are_refused(spark):
    df = docs(spark, [(i, "t", "rare" if i == 0 else "common") for i in range(2000)])
    with pytest.raises(Exception, match="max_rate"):
        mix_sources(df, weights={"rare": 1.0}, max_rate=10.0).count()
    assert mix_sources(df, weights={"rare": 1.0}).count() > 0


def test_rates_above_any_bound_are_right_by_default(spark):
    df = docs(spark, [(i, f"t{i}", "many") for i in range(2000)] + [(5000, "only", "rare")])
    n = mix_sources(df, weights={"rare": 1.0}).count()
    assert abs(n - 2001) < 6 * 2001**0.5


@pytest.mark.parametrize("rate", [499.5, 500.5, 744.0, 2000.0, 31_000.0])
def test_any_rate_has_its_whole_distribution(spark, rate):
    low, cdf = spark.range(1).select(poisson_cdf(F.lit(rate)).alias("t")).first()["t"]
    log_p = lambda k: k * math.log(rate) - rate - math.lgamma(k + 1)
    total = math.fsum(math.exp(log_p(k)) for k in range(low))
    for k, c in enumerate(cdf, low):
        total += math.exp(log_p(k))
        assert abs(c - total) < 1e-9
    assert abs(cdf[-1] - 1) < 1e-9 and cdf[0] < 1e-15


def test_a_source_of_one_row_never_fails_the_default_mix(spark):
    n = 640_000  # a rate of about 800
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 5, "rare").otherwise("common").alias("source"))
    known = {r["mix_source"]: r["rate"] for r in rates(df, "source", None, 0.5, 500.0).collect()}
    assert known["rare"] > 750
    out = {r["source"]: r["n"] for r in mix_sources(df).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(out["rare"] - known["rare"]) < 6 * math.sqrt(known["rare"])
    assert abs(out["common"] - known["common"] * (n - 1)) < 6 * math.sqrt(n)


def test_awkward_rows_are_rows_like_any_other(spark):
    rows = [(i, t, "ab"[k % 2]) for k, (i, t) in enumerate(awkward())] + [(5, "same text", "a"), (20, "x " * 200_000, "a")]
    df = docs(spark, rows)
    for r in mix_sources(df, weights={"a": 30.0, "b": 30.0}).groupBy("doc_id", "text", "source").agg(F.countDistinct("n_copies").alias("kinds"), F.count(F.lit(1)).alias("n"), F.max("n_copies").alias("each"), F.max("copy_no").alias("last")).collect():
        times = sum(x == (r["doc_id"], r["text"], r["source"]) for x in rows)
        assert r["kinds"] == 1 and r["n"] == times * r["each"] and r["last"] == r["each"], r["doc_id"]


def test_rows_without_an_identifier_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string, source string")
    kept = mix_sources(df).select("text").distinct().count()
    assert abs(kept - 2000 * (1 - math.exp(-1))) < 5 * math.sqrt(2000 * 0.24)
