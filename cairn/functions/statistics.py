"""Quantiles that a report needs, as literals and expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many degrees of freedom quantiles are solved for; beyond, a series is good to eight digits.
SOLVED = 30


def t_share(t: float, dof: int) -> float:
    """The chance that a Student variable of whole ``dof`` lies within -t and t, by its finite sum."""
    angle = math.atan(t / math.sqrt(dof))
    sine, cosine = math.sin(angle), math.cos(angle)
    odd = dof % 2
    term, total = (cosine, cosine if dof > 1 else 0.0) if odd else (1.0, 1.0)
    for j in range(2 + odd, dof - 1, 2):
        term *= cosine * cosine * (j - 1) / j
        total += term
    return 2 / math.pi * (angle + sine * total) if odd else sine * total


def t_solved(level: float, dof: int) -> float:
    low, high = 0.0, 1.0
    while t_share(high, dof) < level:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_share(middle, dof) < level else (low, middle)
    return (low + high) / 2


def t_series(level: float) -> tuple[float, ...]:
    """Coefficients of 1, 1/dof, 1/dof^2, ... of the quantile (Cornish and Fisher)."""
    z = NormalDist().inv_cdf((1 + level) / 2)
    powers = {k: z**k for k in (1, 3, 5, 7, 9)}
    #: Divisor and coefficients of z, z^3, z^5, z^7, z^9.
    terms = ((1, (1,)), (4, (1, 1)), (96, (3, 16, 5)), (384, (-15, 17, 19, 3)), (92160, (-945, -1920, 1482, 776, 79)))
    return tuple(sum(c * powers[2 * k + 1] for k, c in enumerate(cs)) / d for d, cs in terms)


def t_quantile(level: float, dof: Column) -> Column:
    """The t that a Student variable of ``dof`` degrees of freedom stays within, either side, with a chance of ``level``; NULL below one."""
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")
    solved = F.get(F.array(*[F.lit(t_solved(level, n)) for n in range(1, SOLVED + 1)]), (dof - 1).cast("int"))
    series = F.lit(0.0)
    for c in reversed(t_series(level)):
        series = series / dof + c
    return F.when(dof < 1, F.lit(None)).when(dof <= SOLVED, solved).otherwise(series)
