"""Column functions over three-state samples.

A sample axis is a number, NaN (the sensor is there, the sample was dropped) or
NULL (there is no such sensor). Aggregates see numbers only: ``known`` turns NaN
into NULL first, and no comparison below is made with a NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEL = ("ax", "ay", "az")
GYRO = ("gx", "gy", "gz")
AXES = ("x", "y", "z")
NAN = float("nan")
#: One standard gravity, and each limb's long axis (an index into x, y, z).
STANDARD_GRAVITY = 9.80665
MOUNT_AXIS = {"wrist": 0, "ankle": 0, "chest": 1}


def known(c: Column | str) -> Column:
    """The value, or NULL where it is NaN or NULL."""
    return F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))


def any_nan(names: Sequence[str] = ACCEL) -> Column:
    """The sample is missing: some axis is NaN."""
    a, b, c = (F.isnan(F.col(n)) for n in names)
    return a | b | c


def all_nan(names: Sequence[str] = ACCEL) -> Column:
    """The sample is blank: every axis is NaN."""
    a, b, c = (F.isnan(F.col(n)) for n in names)
    return a & b & c


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def clip(c: Column, low: float, high: float) -> Column:
    """NULL and NaN stay what they are (``least`` and ``greatest`` alone would hide either)."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def angle(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two vectors; 0 where one has no direction, NULL where one is NULL."""
    na, nb = norm(*a), norm(*b)
    cosine = clip(dot(a, b) / (na * nb), -1.0, 1.0)
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).when(na.isNotNull() & nb.isNotNull(), F.degrees(F.acos(cosine)))


def mount_axis(node: Column) -> Column:
    """Index of the node's long axis; x where the placement is unknown."""
    out = F.lit(0)
    for name, axis in MOUNT_AXIS.items():
        out = F.when(node == name, axis).otherwise(out)
    return out


def along_axis(node: Column, vector: Sequence[Column]) -> Column:
    """The vector's part along the node's long axis."""
    axis = mount_axis(node)
    return F.when(axis == 0, vector[0]).when(axis == 1, vector[1]).otherwise(vector[2])


def observable_angle(theta_deg: float, phi_deg: Column) -> Column:
    """How far a direction at ``phi`` to the axis moves when turned by ``theta`` about it."""
    phi = F.radians(phi_deg)
    cosine = F.pow(F.cos(phi), 2) + F.pow(F.sin(phi), 2) * F.cos(F.radians(F.lit(float(theta_deg))))
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def half_even(value: float) -> int:
    """Rounding to a whole number, ties to even, on the driver."""
    return int(round(value))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
