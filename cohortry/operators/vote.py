"""Ensemble votes as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.scalar import argmax_class


def hard_vote(predictions: Sequence[str | Column]) -> Column:
    """Most frequent class id; ties go to the smallest id."""
    votes = [(p if isinstance(p, Column) else F.col(p)).cast("int") for p in predictions]
    ranked = []
    for vote in votes:
        agreeing = [F.when(other == vote, 1).otherwise(0) for other in votes]
        ranked.append(F.struct(_sum(agreeing).alias("n"), (-vote).alias("negative")))
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return -best["negative"]


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def soft_vote(probabilities: Sequence[str], weights: Sequence[float] | None = None, n_classes: int = 3) -> Column:
    """Mean, or weighted mean, of the members' probability arrays.

    Written out per class, so that it compiles to plain arithmetic.
    """
    if not probabilities:
        raise ValueError("the ensemble has no members")
    if weights is not None and len(weights) != len(probabilities):
        raise ValueError("the number of weights must match the number of members")
    given = [1.0] * len(probabilities) if weights is None else [float(w) for w in weights]
    whole = sum(given)
    return F.array(*[
        _sum([F.element_at(F.col(p), c + 1) * F.lit(w) for p, w in zip(probabilities, given)]) / F.lit(whole)
        for c in range(n_classes)
    ])


def soft_class(probabilities: Column | str) -> Column:
    return argmax_class(probabilities)
