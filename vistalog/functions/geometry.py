"""Rotations as column expressions; quaternions are arrays (w, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(q: Column) -> list[list[Column]]:
    """The nine entries of a quaternion's rotation matrix."""
    w, x, y, z = (F.element_at(q, i) for i in (1, 2, 3, 4))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def forward(q: Column, t: Column, p: list[Column]) -> list[Column]:
    """R p + t."""
    return [r[0] * p[0] + r[1] * p[1] + r[2] * p[2] + F.element_at(t, i + 1) for i, r in enumerate(rotation(q))]


def mix(a: Column, b: Column, share: Column, n: int) -> Column:
    """The array of ``n`` numbers that lies ``share`` of the way from ``a`` to ``b``."""
    return F.array(*[F.element_at(a, i + 1) * (1 - share) + F.element_at(b, i + 1) * share for i in range(n)])


def slerp(a: Column, b: Column, share: Column) -> Column:
    """The unit quaternion that lies ``share`` of the way from ``a`` to ``b`` along the shorter arc.

    Both are normalised first. Where the arc is nearly zero, the straight line stands for it; a null or zero quaternion gives null.
    """
    norm = lambda q: F.sqrt(F.aggregate(q, F.lit(0.0), lambda s, c: s + c * c))
    unit = lambda q: F.when(norm(q) > 0, F.transform(q, lambda c: c / norm(q)))
    p, q = unit(a.cast("array<double>")), unit(b.cast("array<double>"))
    dot = F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    ends = F.struct(p.alias("p"), F.when(dot < 0, F.transform(q, lambda c: -c)).otherwise(q).alias("q"), F.least(F.abs(dot), F.lit(1.0)).alias("dot"))

    def along(e: Column) -> Column:
        arc = F.acos(e["dot"])
        near = e["dot"] > 1 - 1e-10
        left = F.when(near, 1 - share).otherwise(F.sin((1 - share) * arc) / F.nullif(F.sin(arc), F.lit(0.0)))
        right = F.when(near, share).otherwise(F.sin(share * arc) / F.nullif(F.sin(arc), F.lit(0.0)))
        return F.zip_with(e["p"], e["q"], lambda x, y: left * x + right * y)

    # An array of one struct binds what is used several times.
    mixed = F.element_at(F.transform(F.array(ends), along), 1)
    return F.element_at(F.transform(F.array(mixed), lambda m: F.transform(m, lambda c: c / norm(m))), 1)


def yaw_quaternion(yaw: Column) -> Column:
    return F.array(F.cos(yaw / 2), F.lit(0.0), F.lit(0.0), F.sin(yaw / 2))
