"""Confidence of chains and of answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Loss for each link after the first, and the least confidence.
DECAY, FLOOR = 0.95, 0.01
#: Least confidences of the hedges.
HEDGES = ((0.30, "strong"), (0.10, "moderate"), (0.03, "weak"))


def combine(scores: Column, rule: str = "geometric_mean") -> Column:
    """Confidence of a chain from the scores of its links (array<double>); 0 for an empty chain."""
    n = F.size(scores)
    total = lambda start, f: F.aggregate(scores, F.lit(start), f)
    base = {
        "product": total(1.0, lambda a, x: a * x),
        "min": F.array_min(scores),
        "geometric_mean": F.exp(total(0.0, lambda a, x: a + F.ln(F.greatest(x, F.lit(1e-9)))) / F.greatest(n, F.lit(1))),
    }[rule]
    return F.when(n == 0, 0.0).otherwise(F.greatest(base * F.pow(F.lit(DECAY), n - 1), F.lit(FLOOR)))


def hedge(confidence: Column) -> Column:
    out = F.when(confidence >= HEDGES[0][0], HEDGES[0][1])
    for least, name in HEDGES[1:]:
        out = out.when(confidence >= least, name)
    return out.otherwise("uncertain")


def weakest(scores: Column) -> Column:
    """Index of the first least score, from 0."""
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")
