import hashlib
import random
import re
import zlib

from kinelake.llm import runs as R
from kinelake.llm.runs import collapse_runs, lyndon_edges, planted, runs_of

from .helpers import awkward, docs, sha


def all_runs(x):
    """Every stretch of every period, looked at one by one."""
    out = []
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            length = i + p - start
            if length >= max(6, 4 * p) and not any(a <= start and start + length <= a + n and p % q == 0 for a, n, q in out):
                out.append((start, length, p))
            if i == start:
                i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    x = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
    while len(x) < rng.randrange(2, 90):
        pick = rng.random()
        if pick < 0.3:
            x.append(rng.randrange(4))
        elif pick < 0.9:
            x += x[rng.randrange(len(x)) :] * rng.randrange(1, 6)
        else:
            x = x * 2
    return x[:200]


def test_lyndon_arrays_and_runs_are_the_plain_ones():
    rng = random.Random(11)
    for _ in range(700):
        x = repetitive(rng)
        for down in (False, True):
            key = [-v if down else v for v in x]
            after, agree = lyndon_edges(x, down)
            for i in range(len(x)):
                j = next((j for j in range(i + 1, len(x)) if key[j:] < key[i:]), len(x))
                assert after[i] == j, (x, down, i)
                if j < len(x):
                    same = next((k for k in range(len(x)) if j + k == len(x) or x[i + k] != x[j + k]))
                    assert agree[i] == same, (x, down, i)
        assert runs_of(x) == all_runs(x), x


class Counted:
    compared = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.compared += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.compared += 1
        return self.v < other.v


def test_comparisons_are_linear():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20_000:
        fib.append(fib[-1] + fib[-2])
    nested, c = [0], 1
    while len(nested) < 20_000:
        nested, c = nested * 4 + [c], c + 1
    for x in ([1] * 20_000, fib[-1], nested * 2, [0, 1] * 10_000, list(range(20_000)), list(range(20_000))[::-1], ([0] * 50 + [1]) * 400):
        for down in (False, True):
            Counted.compared = 0
            lyndon_edges([Counted(v) for v in x], down)
            assert Counted.compared <= 5 * len(x)


def expected(doc, text):
    x = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(x)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    found = all_runs(x) if n < 3000 else runs_of(x)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return found, " ".join(w for i, w in enumerate(x) if i not in dropped)


def test_query_equals_the_definition(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        found, kept = expected(r["doc_id"], r["text"])
        top = min(found, key=lambda t: (-t[1], t[0], t[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want[r["doc_id"]] = (len(found), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(kept))
    got = {r["doc_id"]: tuple(r)[1:] for r in R.query(spark, sf_dir).collect()}
    assert got == want and any(w[0] for w in want.values())


def test_awkward_rows(spark):
    rows = awkward() + [(20, "a b " * 5 + "c"), (21, "x y " * 7), (22, "z " * 6), (23, "z " * 5)]
    got = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in collapse_runs(docs(spark, rows), rewrite=planted).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted([(d, *expected(d, t)) for d, t in rows], key=key)
    plain = {r["doc_id"]: r for r in collapse_runs(docs(spark, rows)).where("doc_id > 19").collect()}
    assert [tuple(x) for x in plain[20]["runs"]] == [(0, 10, 2)] and plain[20]["collapsed"] == "a b c"
    assert plain[22]["collapsed"] == "z" and plain[23]["runs"] == []


def test_clashing_columns_and_empty_table(spark):
    some = docs(spark, [(1, "q " * 8)]).withColumnRenamed("source", "runs").withColumnRenamed("lang", "collapsed")
    out = collapse_runs(some, keep=("runs", "collapsed"))
    assert out.columns == ["doc_id", "runs", "collapsed", "runs_1", "collapsed_1"] and out.collect()[0]["collapsed_1"] == "q"
    assert collapse_runs(some.limit(0)).collect() == []


def test_digest_of_no_runs():
    assert hashlib.sha256(b"").hexdigest() == sha("")
