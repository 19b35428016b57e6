"""Rounding that both engines agree on.

Means of short decimals lie exactly on ties, where the last bit of a sum, and so
the order of its terms, would decide. A fixed nudge far below the last digit kept, with more digits than any such mean,
moves them off, on both sides alike; a negative zero becomes plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUDGE = 1.2345678912345e-9


def near(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits) + F.lit(0.0)


def near_sql(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + {NUDGE}, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, but for times, which are exact."""
    return df.select(*[near(n, digits).alias(n) if t == "double" and n not in ("onset", "detected_by") else F.col(n) for n, t in df.dtypes])


def nudged(sql: str) -> str:
    """``sql`` with every NEAR(expression, digits) written out."""
    while (at := sql.rfind("NEAR(")) >= 0:
        depth, comma, end = 0, 0, at + 4
        for i in range(at + 4, len(sql)):
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            if not depth:
                end = i
                break
        sql = sql[:at] + near_sql(sql[at + 5 : comma].strip(), int(sql[comma + 1 : end])) + sql[end + 1 :]
    return sql
