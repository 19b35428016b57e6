import pytest
from pyspark.sql import functions as F

from kinelake.operators import answers as A


def counting(folder, broken=None):
    """A sender that writes down each prompt it is sent; while ``broken`` is there it fails after a dozen."""

    def send(prompts):
        import uuid
        from pathlib import Path

        if broken and Path(broken).exists() and len(list(Path(folder).iterdir())) >= 12:
            raise ConnectionError("no network")
        for p in prompts:
            (Path(folder) / uuid.uuid4().hex).write_text(p)
        return [f"<{p}>" for p in prompts]

    return send


def sent(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_a_job_that_fails_midway_is_taken_up_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "BATCH", 3)
    log, broken, store = tmp_path / "log", tmp_path / "broken", f"file://{tmp_path}/store"
    log.mkdir()
    broken.touch()
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id long, prompt string").repartition(5)
    send = counting(str(log), str(broken))
    with pytest.raises(Exception, match="no network"):
        A.score_once(prompts, store, send, "openai", "m")
    before = sent(log)
    assert A.answered(spark, store).count() == len(set(before)) < 60
    broken.unlink()
    out = A.score_once(prompts, store, send, "openai", "m")
    assert {(r["id"], r["response"]) for r in out.collect()} == {(i, f"<p{i}>") for i in range(60)}
    assert sent(log) == sorted(f"p{i}" for i in range(60)) and len(before) >= 12  # nothing twice
    A.score_once(prompts, store, send, "openai", "m")
    assert len(sent(log)) == 60
    more = prompts.unionByName(spark.createDataFrame([(99, "p99"), (100, "p3")], "id long, prompt string"))
    assert A.score_once(more, store, send, "openai", "m").count() == 62 and len(sent(log)) == 61


def test_styles_models_and_repeats_are_asks_of_their_own(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    send = counting(str(log))
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id long, prompt string")
    out = A.score_once(prompts, store, send, "s", "m", repeats=3).collect()
    assert len(out) == 12 and len(sent(log)) == 6 and {r["repeat"] for r in out} == {0, 1, 2}
    A.score_once(prompts, store, send, "s", "n")
    A.score_once(prompts, store, send, "t", "m")
    assert len(sent(log)) == 10
    spread = spark.createDataFrame(out).groupBy("id").agg(F.count_distinct("response").alias("n"))
    assert {r["n"] for r in spread.collect()} == {1}


def test_names_do_not_run_together(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc")], "p string, r string")
    assert rows.select(A.ask_name("s", "m", F.col("p"), F.col("r")).alias("n")).distinct().count() == 2


def test_too_few_answers_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="1 answers to 2 prompts"):
        A.score_once(spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1), str(tmp_path / "s"), lambda prompts: ["x"], "s", "m")


def test_nothing_to_ask(spark, tmp_path):
    assert A.score_once(spark.createDataFrame([], "prompt string"), str(tmp_path / "s"), lambda prompts: [], "s", "m").count() == 0
