import itertools

import numpy as np
import pytest

from kinelake.llm import minhash as M
from kinelake.llm.minhash import keep_one, near_groups

from .helpers import awkward, docs, edited, prose, words


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), doc) if x is not None], default=None)
    return sorted([(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], key=repr)


def mixed(seed):
    base = [prose(n, seed + i) for i, n in enumerate((6, 12, 60, 150, 400, 900))]
    rows = [(i, edited(base[i % 6], (i % 9) / 60, seed * 1000 + i)) for i in range(150)]
    passage = prose(80, seed + 50)
    rows += [(500 + i, prose(30, seed * 77 + i) + " " + passage) for i in range(60)]
    return rows + [(900 + i, base[3] + " tail" * (i % 3)) for i in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = mixed(seed) + awkward()
    got = near_groups(docs(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_of_links_are_one_group(spark):
    text, rows = prose(300, 5).split(), []
    for i in range(12):  # each differs from the next by a little, the ends by much
        rows.append((i, " ".join(text[i * 15 :] + [f"n{j}" for j in range(i * 15)])))
    expected = brute(rows)
    assert len({r[2] for r in expected}) == 1
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_groups(docs(spark, rows)).collect()], key=repr) == expected


def test_bounds_hold_for_random_pairs():
    rng = np.random.default_rng(1)
    for n in (20, 100, 128, 200, 700, 3000):
        for _ in range(60):
            both = int(n * rng.uniform(0.858, 1.0))
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            i = len(np.intersect1d(a, b))
            if 4 * i < 3 * (len(a) + len(b) - i):
                continue
            x, y = sorted((len(a), len(b)))
            assert len(np.intersect1d(a[: M.SKETCH], b[: M.SKETCH])) >= M.shared_at_least(x, y)
            assert M.shared_with_any(len(a)) <= M.shared_at_least(x, y)


def test_parity_bits_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.int64).astype(np.uint64))
        a, b = pool[:300], pool[rng.integers(0, 150) :]
        differ = int(np.bitwise_count((M.parity(a, 0) ^ M.parity(b, 0)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0


def test_one_of_each_group_stays(spark):
    text = prose(200, 8)
    df = docs(spark, [(3, text), (1, text + " a"), (2, text + " b"), (9, "other words are here for sure"), (None, text)]).withColumnRenamed("lang", "gone_id")
    out = keep_one(df)
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {1, 9, None}


def test_empty_table(spark):
    assert near_groups(docs(spark, [])).count() == 0
