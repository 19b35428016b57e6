import hashlib
import random

from pyspark.sql import functions as F

from kinelake.llm import chat as C

from .helpers import prose, sha

TREE = "conv_id long, node long, parent long, role string, text string, score double"


def test_best_paths_of_random_trees(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for conv in range(30):
        n = rng.randrange(1, 40)
        parent = {i: (rng.randrange(max(0, i - 3), i) if i and rng.random() > 0.05 else None) for i in range(n)}
        score = {i: rng.randrange(-3, 4) / 2 for i in range(n)}
        rows += [(conv, i, parent[i], "user" if i % 2 == 0 else "assistant", f"m{i}", score[i]) for i in range(n)]
        best = None
        for leaf in set(range(n)) - {p for p in parent.values() if p is not None}:
            path, i = [], leaf
            while i is not None:
                path.append(i)
                i = parent[i]
            total = sum(score[i] for i in path)
            if best is None or (-total, leaf) < (-best[0], best[1]):
                best = (total, leaf, path[::-1])
        expected[conv] = best
    out = C.format_paths(C.chosen_paths(spark.createDataFrame(rows, TREE))).withColumn("back", C.parse(F.col("formatted")))
    for r in out.collect():
        total, leaf, path = expected.pop(r["conv_id"])
        assert r["leaf"] == leaf and r["branch_score"] == total
        assert [t["text"] for t in r["back"]] == [f"m{i}" for i in path]
    assert not expected


def test_all_branches(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "a", 1.0), (1, 2, 0, "assistant", "b", 2.0), (1, 3, 1, "user", "c", 0.0)]
    got = {r["leaf"]: r["formatted"] for r in C.format_paths(C.chosen_paths(spark.createDataFrame(rows, TREE), top=None)).collect()}
    assert set(got) == {2, 3} and got[2].count(C.START) == 2 and got[3].count(C.START) == 3


def test_cycles_orphans_and_nulls(spark):
    rows = [(1, 1, 2, "user", "x", 0.0), (1, 2, 1, "user", "y", 0.0), (1, 3, 2, "user", "z", 0.0), (1, 4, 99, "user", "orphan", 0.0), (None, 1, None, None, None, None), (2, 5, None, "user", "only", 0.0)]
    got = {r["conv_id"]: r["formatted"] for r in C.format_paths(C.chosen_paths(spark.createDataFrame(rows, TREE))).collect()}
    assert got == {1: f"{C.START}user\norphan{C.END}\n", None: f"{C.START}\n{C.END}\n", 2: f"{C.START}user\nonly{C.END}\n"}
    assert C.format_paths(C.chosen_paths(spark.createDataFrame([], TREE))).count() == 0


def test_hostile_texts_come_back_and_only_assistants_count(spark):
    pieces = ["<|im_end|>", "<|im_start|>", "\\", "\\\\|", "<\\|", "<", "|", "\n", "assistant", "", "ü😀", "$1", "\\n"]
    rng = random.Random(2)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "odd\nrole\\n", None]), rng.choice([None, *("".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(4))])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = C.format_paths(C.chosen_paths(C.linear_tree(table)))
    for r in out.withColumn("back", C.parse(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("spans"))).collect():
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [(b["role"], b["text"]) for b in r["back"]] == [(role, text) for _, role, text in own]
        assert r["loss"] == "".join(text for _, role, text in own if role == "assistant")
        assert sha(r["formatted"]) == hashlib.sha256(r["formatted"].encode()).hexdigest()
        assert r["formatted"].count(C.END) == len(own)


def test_very_long_texts_and_conversations(spark):
    long = prose(60_000, 5) + " <|im_end|> \\ " + prose(60_000, 6)
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), *[(2, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_paths(C.chosen_paths(C.linear_tree(table))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("spans"))).withColumn("back", C.parse(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert got[1]["loss"] == long and [b["text"] for b in got[1]["back"]] == ["q", long]
    assert [b["text"] for b in got[2]["back"]] == [f"t{i}" for i in range(3000)]
