import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinelake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_are_those_of_the_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    cur = db.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", ["motion_level", "render_features", "score_windows"])
def test_a_motion_on_the_edge_of_a_band_is_on_the_sqls_side(spark, tmp_path, name):
    # Two samples of the wrist whose deviations add up to a band's edge exactly; in doubles those of the first three are below it, whichever is first.
    edges = [(0.07, 3, 70, 31), (0.49, 42, 70, 31), (0.07, 17, 16, 5), (0.0, 0, 70, 31), (0.0, 3, 16, 5)]
    ids = {node: iter([i for i in range(node, 3000, 3) if i % 11 and i % 13]) for node in (0, 1)}
    rows = []
    for user, (value, k, more, further) in enumerate(edges):
        rows += [(next(ids[1]), 40 * j, 4 * user + 1, 10.0 + j, 5 * j) for j in range(7)]
        rows += [(next(ids[0]), 20, 4 * user + 1, value, k), (next(ids[0]), 60, 4 * user + 1, round(value + more, 2), k + further)]
    con = duckdb.connect()
    con.execute("CREATE TABLE made (event_id BIGINT, h BIGINT, user_id BIGINT, value DOUBLE, k BIGINT)")
    con.executemany("INSERT INTO made VALUES (?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_hours(h) AS ts, user_id, 'view' AS event_type, value, '{\"k\": ' || k || '}' AS props FROM made")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall()
    levels = con.execute(f"SELECT motion_level FROM ({SQL['motion_level']}) WHERE node = 'wrist' ORDER BY subject").fetchall()
    assert levels == [("moderate",), ("moderate",), ("still",), ("vigorous",), ("moderate",)]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in expected)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() >= 0
    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())


def test_the_rest_of_the_library_does_not_need_the_training_subpackage():
    root = Path(entry.__file__).parent / "kinelake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "kinelake.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text(), p
