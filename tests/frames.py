"""Small three-node windows for tests."""

import math

NAN = float("nan")
SCHEMA = "dataset string, subject string, seg long, win long, start double, end double, node string, idx int, t double, ax double, ay double, az double, gx double, gy double, gz double, has_gyro boolean"


def window(nodes=("wrist", "chest", "ankle"), n=100, rate=100.0, win=0, accel=None, gyro=(1.0, 2.0, 3.0), no_gyro=("chest",), shift=None, start=0.0):
    """Rows of one window; ``accel(node, i)`` gives a sample, ``shift[node]`` seconds are added to its clock."""
    make = accel or (lambda node, i: (0.1 * math.sin(i / 5), 0.9, 0.2))
    rows = []
    for node in nodes:
        has = node not in no_gyro
        for i in range(n):
            g = gyro if has else (None, None, None)
            rows.append(("toy", "s1", 1, win, start, start + n / rate, node, i + 1, start + i / rate + (shift or {}).get(node, 0.0), *map(float, make(node, i)), *g, has))
    return rows


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_node(df, *columns):
    return {r["node"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
