"""Queries over the other driver tables: label checks, confusion, confidence, excerpts and a dense series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confidence as Co
from ..labels import missing_activities, verify_labels
from ..operators import agent as Ag
from ..operators import effects as X
from ..operators import features as Fe
from ..operators import sampling as Sa
from ..operators import score as S
from ..operators import segment as G
from .rounding import near, nudged

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}
TYPES = ["click", "error", "purchase", "signup", "view"]
LABELS = ["A", "B", "C", "D"]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (f, nudged(sql))
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- labels -------------------------------------------------------------------------------------

_DIM = [(1, "view", "mapped"), (2, "click", "mapped"), (3, "purchase", "excluded"), (4, "signup", "documented"), (7, "nap", "mapped")]
_DIM_SQL = "(VALUES " + ", ".join(map(str, _DIM)) + ") AS d(activity_id, name, role)"
_COUNTS_SQL = "SELECT CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 99 END AS activity_id, count(*) AS n FROM events GROUP BY 1"


def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    activity = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(99)
    return read(spark, sf_dir, "events").groupBy(activity.alias("activity_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "label_verify_tiers",
    f"""
WITH c AS ({_COUNTS_SQL}), b AS (SELECT coalesce(c.activity_id, d.activity_id) AS activity_id, name, role, coalesce(n, 0)::BIGINT AS n FROM c FULL JOIN {_DIM_SQL} ON c.activity_id = d.activity_id),
f AS (SELECT *, CASE WHEN role = 'mapped' AND n = 0 THEN 'missing' WHEN role = 'mapped' AND n < 500 THEN 'thin' WHEN role = 'mapped' THEN 'expected' WHEN role = 'excluded' AND n > 0 THEN 'excluded by design'
  WHEN role = 'documented' AND n > 0 THEN 'documented, outside the label sets' WHEN role IS NULL AND n >= 1000 THEN 'undocumented' WHEN role IS NULL THEN 'undocumented, few rows' ELSE 'not present' END AS finding FROM b)
SELECT activity_id, name, n, CASE WHEN finding IN ('missing', 'thin', 'undocumented') THEN 'WARN' WHEN finding LIKE 'excluded%' OR finding LIKE 'documented%' THEN 'INFO' ELSE 'OK' END AS tier, finding FROM f""",
)
def label_verify_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_labels(activity_counts(spark, sf_dir), spark.createDataFrame(_DIM, "activity_id int, name string, role string"))


@query("missing_activities", f"SELECT activity_id, name, role FROM {_DIM_SQL} WHERE role = 'mapped' AND activity_id NOT IN (SELECT activity_id FROM ({_COUNTS_SQL}))")
def missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_activities(activity_counts(spark, sf_dir), spark.createDataFrame(_DIM, "activity_id int, name string, role string"))


# --- confusion ----------------------------------------------------------------------------------

_PAIRS_SQL = f"SELECT event_type AS true_label, CASE WHEN (event_id * event_id) % 7 < 3 THEN {TYPES}[CAST((event_id // 3) % 5 + 1 AS INTEGER)] ELSE event_type END AS predicted_label FROM events"


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.floor(F.col("event_id") / 3) % 5 + 1).cast("int"))
    said = F.when((F.col("event_id") * F.col("event_id")) % 7 < 3, other).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("true_label"), said.alias("predicted_label"))


@query("class_confusion", f"SELECT true_label, " + ", ".join(f"count(*) FILTER (WHERE predicted_label = '{t}') AS {t}" for t in TYPES) + f" FROM ({_PAIRS_SQL}) GROUP BY true_label")
def class_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_confusion(label_pairs(spark, sf_dir), TYPES)


@query(
    "confusion_topk",
    f"""
WITH c AS (SELECT true_label, predicted_label, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY true_label) AS of_true FROM c)
SELECT true_label, predicted_label, n, NEAR(n / of_true, 6) AS rate_of_true_class FROM t WHERE true_label <> predicted_label
ORDER BY n DESC, list_position({TYPES}, true_label), list_position({TYPES}, predicted_label) LIMIT 3""",
)
def confusion_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_confused(label_pairs(spark, sf_dir), TYPES).withColumn("rate_of_true_class", near("rate_of_true_class", 6))


#: Activities that stand for the event types, so that stairs and postures are among them.
ACTIVITIES = ["ascending_stairs", "lying", "sitting", "standing", "walking"]
_POSTURES = "('lying', 'sitting', 'standing')"


@query(
    "fix_ranking",
    f"""
WITH p AS (SELECT {ACTIVITIES}[list_position({TYPES}, true_label)] AS true_label, {ACTIVITIES}[list_position({TYPES}, predicted_label)] AS predicted_label FROM ({_PAIRS_SQL})),
c AS (SELECT true_label, predicted_label, count(*) AS n FROM p WHERE true_label <> predicted_label GROUP BY ALL),
t AS (SELECT * FROM c ORDER BY n DESC, list_position({ACTIVITIES}, true_label), list_position({ACTIVITIES}, predicted_label) LIMIT 5),
s AS (SELECT greatest(coalesce(sum(n), 0), 1) AS all_n, coalesce(sum(n) FILTER (WHERE 'ascending_stairs' IN (true_label, predicted_label)), 0) AS stairs_n,
  coalesce(sum(n) FILTER (WHERE true_label IN {_POSTURES} AND predicted_label IN {_POSTURES}), 0) AS posture_n, (SELECT avg((true_label = predicted_label)::INT) FROM p) AS accuracy FROM t)
SELECT NEAR(stairs_n / all_n, 6) AS stair_share, NEAR(posture_n / all_n, 6) AS posture_share,
  CASE WHEN stairs_n / all_n >= 0.5 THEN 'drop the stair classes' WHEN posture_n >= 0.3 * all_n THEN 'richer features' WHEN accuracy < 0.25 THEN 'few-shot examples and prompt' ELSE 'better few-shot examples' END AS first_fix FROM s""",
)
def fix_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*[x for t, a in zip(TYPES, ACTIVITIES, strict=True) for x in (F.lit(t), F.lit(a))])
    pairs = label_pairs(spark, sf_dir).select(named[F.col("true_label")].alias("true_label"), named[F.col("predicted_label")].alias("predicted_label"))
    accuracy = pairs.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("int"))).first()[0]
    out = S.fix_ranking(S.top_confused(pairs, ACTIVITIES, 5), accuracy or 0.0)
    return out.select(near("stair_share", 6).alias("stair_share"), near("posture_share", 6).alias("posture_share"), "first_fix")


# --- confidence ---------------------------------------------------------------------------------

_TOKENS = ["A", " A", "b\n", "▁C", "x"]


def candidates() -> Column:
    """The first five numbers of an embedding as log-probabilities of five tokens."""
    return F.array(*[F.struct(F.lit(t).alias("token"), F.element_at("embedding", i + 1).cast("double").alias("logprob")) for i, t in enumerate(_TOKENS)])


def readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("lp", Co.label_logprobs(candidates(), LABELS)).withColumn("dist", Co.distribution(F.col("lp")))
    return rows.select("vec_id", "label", "dist", Co.predicted(F.col("dist")).alias("predicted"), Co.max_p(F.col("dist")).alias("max_p"), Co.log_margin(F.col("lp")).alias("log_margin"), Co.entropy(F.col("dist")).alias("entropy"))


_READOUT_SQL = """
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3, embedding[4]::DOUBLE AS e4 FROM embeddings),
l AS (SELECT vec_id, label, greatest(e1, e2) + ln(exp(e1 - greatest(e1, e2)) + exp(e2 - greatest(e1, e2))) AS a, e3 AS b, e4 AS c FROM e),
w AS (SELECT *, exp(a) + exp(b) + exp(c) AS z, list_reverse_sort([a, b, c]) AS o FROM l),
p AS (SELECT *, exp(a) / z AS pa, exp(b) / z AS pb, exp(c) / z AS pc FROM w),
r AS (SELECT vec_id, label, pa, pb, pc, CASE WHEN pa >= pb AND pa >= pc THEN 'A' WHEN pb >= pc THEN 'B' ELSE 'C' END AS predicted, greatest(pa, pb, pc) AS max_p, o[1] - o[2] AS log_margin, -(pa * ln(pa) + pb * ln(pb) + pc * ln(pc)) AS entropy FROM p)
"""


def response_bodies() -> dict[str, Column]:
    """The candidates as each service style answers with them, as JSON."""
    pairs = candidates()
    as_map = F.map_from_entries(pairs)
    log_p = F.transform(pairs, lambda c: F.struct(c["token"].alias("token"), c["logprob"].alias("logProbability")))
    named = F.transform(pairs, lambda c: F.struct(c["token"].alias("tok_str"), c["logprob"].alias("logprob")))
    return {
        "llamacpp": F.to_json(F.struct(F.array(F.struct(named.alias("probs"))).alias("completion_probabilities"))),
        "vllm": F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.lit(None).cast("map<string,double>"), as_map).alias("top_logprobs")).alias("logprobs"))).alias("choices"))),
        "ollama_native": F.to_json(F.struct(F.array(F.struct(pairs.alias("top_logprobs"))).alias("logprobs"))),
        "gemini": F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(log_p.alias("candidates"))).alias("topCandidates")).alias("logprobsResult"))).alias("candidates"))),
        "openai": F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(pairs.alias("top_logprobs"))).alias("content")).alias("logprobs"))).alias("choices"))),
    }


@query(
    "extract_styles",
    _READOUT_SQL + "SELECT style, vec_id, predicted, NEAR(max_p, 6) AS max_p, NEAR(log_margin, 6) AS log_margin, 'logprob' AS confidence_method FROM r, (SELECT unnest(['llamacpp', 'vllm', 'ollama_native', 'gemini', 'openai']) AS style)",
)
def extract_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every service's response to one distribution: five formats, one answer."""
    out = None
    for style, body in response_bodies().items():
        rows = Ag.readouts(read(spark, sf_dir, "embeddings").select("vec_id", body.alias("response")), style, LABELS, "p", "m")
        part = rows.select(F.lit(style).alias("style"), "vec_id", "predicted", near("max_p", 6).alias("max_p"), near("log_margin", 6).alias("log_margin"), "confidence_method")
        out = part if out is None else out.unionByName(part)
    return out


@query("softmax_confidence", _READOUT_SQL + "SELECT vec_id, predicted, NEAR(max_p, 6) AS max_p, NEAR(log_margin, 6) AS log_margin, NEAR(entropy, 6) AS entropy, NEAR(pa, 6) AS p_a, NEAR(pb, 6) AS p_b, NEAR(pc, 6) AS p_c, 0.0::DOUBLE AS p_d FROM r")
def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readouts(spark, sf_dir)
    return rows.select("vec_id", "predicted", *[near(c, 6).alias(c) for c in ("max_p", "log_margin", "entropy")], *[near(F.col("dist")[i]["p"], 6).alias(f"p_{x.lower()}") for i, x in enumerate(LABELS)])


@query(
    "confidence_gate",
    _READOUT_SQL + "SELECT (label % 4)::INTEGER AS grp, count(*) AS n, count(*) FILTER (WHERE max_p > 0.25 + 0.1) AS passed FROM r GROUP BY 1",
)
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readouts(spark, sf_dir).withColumn("ok", X.gate(F.col("dist"), 0.1))
    return rows.groupBy((F.col("label") % 4).cast("int").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))


@query(
    "by_condition",
    _READOUT_SQL
    + "SELECT condition, count(*) AS n, NEAR(avg((predicted = truth)::INT), 6) AS accuracy, NEAR(avg(max_p), 6) AS mean_max_p, NEAR(avg(log_margin), 6) AS mean_log_margin, NEAR(avg(entropy), 6) AS mean_entropy FROM (SELECT *, CASE WHEN label % 2 = 0 THEN 'healthy' ELSE 'injected' END AS condition, ['A', 'B', 'C', 'D'][CAST(label % 4 + 1 AS INTEGER)] AS truth FROM r) GROUP BY condition",
)
def by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("label") % 4 + 1).cast("int"))
    rows = readouts(spark, sf_dir).withColumn("condition", F.when(F.col("label") % 2 == 0, "healthy").otherwise("injected")).withColumn("label", truth)
    out = X.by_condition(rows)
    return out.select("condition", "n", *[near(c, 6).alias(c) for c in ("accuracy", "mean_max_p", "mean_log_margin", "mean_entropy")])


@query("group_summary", _READOUT_SQL + "SELECT label, count(max_p) AS n, NEAR(avg(max_p), 6) AS mean, NEAR(min(max_p), 6) AS min, NEAR(max(max_p), 6) AS max, NEAR(stddev_pop(max_p), 6) AS sd FROM r GROUP BY label")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.group_summary(readouts(spark, sf_dir), ["label"], "max_p")
    return out.select("label", "n", *[near(c, 6).alias(c) for c in ("mean", "min", "max", "sd")])


@query(
    "self_consistency_votes",
    """
WITH a AS (SELECT vec_id, ['A', 'B', 'C', 'D', 'E'][CAST(CAST(floor(abs(x::DOUBLE) * 1000) AS BIGINT) % 5 + 1 AS INTEGER)] AS v FROM (SELECT vec_id, unnest(embedding[1:10]) AS x FROM embeddings)),
c AS (SELECT vec_id, count(*) FILTER (WHERE v <> 'E') AS valid, count(*) FILTER (WHERE v = 'A') AS a, count(*) FILTER (WHERE v = 'B') AS b, count(*) FILTER (WHERE v = 'C') AS c, count(*) FILTER (WHERE v = 'D') AS d FROM a GROUP BY vec_id)
SELECT vec_id, valid, NEAR(a / nullif(valid, 0), 6) AS p_a, NEAR(b / nullif(valid, 0), 6) AS p_b, NEAR(c / nullif(valid, 0), 6) AS p_c, NEAR(d / nullif(valid, 0), 6) AS p_d, NEAR(1 / nullif(valid, 0), 6) AS resolution FROM c""",
)
def self_consistency_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.array(*[F.lit(x) for x in "ABCDE"])
    answers = F.transform(F.slice("embedding", 1, 10), lambda x: F.concat(F.lit(" "), F.element_at(letters, (F.floor(F.abs(x.cast("double")) * 1000) % 5 + 1).cast("int")), F.lit("\n")))
    rows = read(spark, sf_dir, "embeddings").withColumn("answers", answers).withColumn("dist", Co.vote_distribution(F.col("answers"), LABELS))
    valid = F.size(F.filter("answers", lambda a: Co.label_token(a).isin(LABELS))).cast("long")
    return rows.withColumn("valid", valid).select("vec_id", "valid", *[near(F.col("dist")[i]["p"], 6).alias(f"p_{x.lower()}") for i, x in enumerate(LABELS)], near(F.try_divide(F.lit(1.0), F.col("valid")), 6).alias("resolution"))


@query(
    "determinism_spread",
    "SELECT label, count(*) AS n, NEAR(max(v) - min(v), 6) AS spread, count(DISTINCT round(v, 12)) <= 1 AS identical FROM (SELECT label, CASE WHEN label % 3 = 0 THEN 0.5::DOUBLE ELSE embedding[1]::DOUBLE END AS v FROM embeddings) GROUP BY label",
)
def determinism_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.when(F.col("label") % 3 == 0, 0.5).otherwise(F.element_at("embedding", 1).cast("double")).alias("v"))
    return X.repeat_spread(rows, ["label"], "v").withColumn("spread", near("spread", 6))


@query("provider_slug", "SELECT c_custkey, CASE WHEN s = '' THEN 'unknown' ELSE trim(regexp_replace(s, '[^A-Za-z0-9._-]+', '-', 'g'), '-') END AS slug FROM (SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS s FROM customer)")
def provider_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", Co.slug(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))).alias("slug"))


# --- excerpts and a dense series ----------------------------------------------------------------


@query(
    "middle_excerpt",
    """
WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS place, count(*) OVER (PARTITION BY l_suppkey) AS n_of FROM lineitem),
b AS (SELECT *, least(300, n_of) AS taken, greatest(0, n_of // 2 - least(300, n_of) // 2) AS begin_at FROM n)
SELECT l_suppkey, l_orderkey, l_linenumber FROM b WHERE place >= begin_at AND place < begin_at + taken AND (place - begin_at) % greatest(1, taken // 128) = 0""",
)
def middle_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return Sa.middle_excerpt(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], 300).drop("l_shipdate")


_DAY, _SPAN, _DENSE_GAP = 1.0, 180.0, 30.0


@query(
    "dense_windows",
    f"""
WITH s AS (SELECT l_suppkey AS subject, date_diff('day', TIMESTAMP '1990-01-01', l_shipdate)::DOUBLE AS t, l_orderkey * 8 + l_linenumber AS ord, l_quantity AS x, l_extendedprice / 1000.0 AS y, l_discount * 100.0 AS z FROM lineitem),
g AS (SELECT *, sum(brk) OVER (PARTITION BY subject ORDER BY t, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {_DENSE_GAP} THEN 1 ELSE 0 END AS brk FROM s WINDOW w AS (PARTITION BY subject ORDER BY t, ord))),
b AS (SELECT subject, seg, min(t) AS t0, max(t) AS t1 FROM g GROUP BY ALL),
w AS (SELECT subject, seg, win, t0 + win * {_SPAN / 2} AS ws FROM (SELECT *, unnest(range(0, CAST(floor((t1 - t0 - {_SPAN}) / {_SPAN / 2}) AS BIGINT) + 1)) AS win FROM b WHERE t1 - t0 >= {_SPAN}))
SELECT g.subject, g.seg, w.win, count(*) AS n, """
    + ", ".join(f"NEAR(avg({a}), 6) AS acc_{a}_mean, NEAR(stddev_pop({a}), 6) AS acc_{a}_std, min({a}) AS acc_{a}_min, max({a}) AS acc_{a}_max, NEAR(avg({a} * {a}), 5) AS acc_{a}_energy" for a in "xyz")
    + f" FROM g JOIN w ON g.subject = w.subject AND g.seg = w.seg AND t >= ws AND t < ws + {_SPAN} GROUP BY g.subject, g.seg, w.win HAVING count(*) >= 5",
)
def dense_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five statistics an axis over half-overlapping windows of a series with hundreds of samples a subject."""
    rows = read(spark, sf_dir, "lineitem")
    samples = rows.select(
        F.lit("lineitem").alias("dataset"), F.col("l_suppkey").alias("subject"), F.datediff("l_shipdate", F.lit("1990-01-01")).cast("double").alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.lit("shipping").alias("activity"), F.lit("all").alias("node"), F.col("l_quantity").alias("ax"), (F.col("l_extendedprice") / 1000.0).alias("ay"), (F.col("l_discount") * 100.0).alias("az"),
    )
    segmented = G.segments(samples, _DENSE_GAP, 365.0, by_activity=False)
    frames = G.frames(segmented, G.sliding_windows(segmented, _SPAN), _SPAN / 4, least=5)
    f = Fe.plain_features(frames, ("subject", "seg", "win"))
    digits = {"mean": 6, "std": 6, "energy": 5}
    stats = [near(c, digits[c.rsplit("_", 1)[1]]).alias(c) if c.rsplit("_", 1)[1] in digits else F.col(c) for c in f.columns if c.startswith("acc_")]
    return f.select("subject", "seg", "win", F.col("n_frames").alias("n"), *stats)
