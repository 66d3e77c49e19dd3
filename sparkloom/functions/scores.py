"""Vector, hardness and weighting formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def normalized(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def score_hardness(score: Column, low: float = 0.0, high: float = 10.0, invert: bool = True) -> Column:
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))
    at = F.when(score.isNotNull(), at)
    return 1.0 - at if invert else at


def similarity_hardness(similarity: Column, threshold: float = 0.9) -> Column:
    """0.5 at the threshold, 1 at similarity 1; bounded to [0, 1], also at the thresholds 0 and 1."""
    above = F.lit(0.5) + (0.5 * (similarity - threshold) / (1 - threshold) if threshold < 1 else F.lit(0.5))
    below = 0.5 * similarity / threshold if threshold > 0 else F.lit(0.0)
    value = F.when(similarity >= threshold, above).when(similarity.isNotNull(), below)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def uncertainty_hardness(confidence: Column, entropy: Column | None = None) -> Column:
    """1 - confidence, averaged with half the entropy (1 at most) where an entropy is present; 0 counts as present."""
    base = 1.0 - confidence
    if entropy is None:
        return base
    return F.when(entropy.isNotNull(), (base + F.least(F.lit(1.0), entropy / 2.0)) / 2.0).otherwise(base)


def weighted_mean(values: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Mean of the present values by weight; a missing weight is 0, no weights at all count alike, no total gives 0."""
    pairs = [(v, 1.0 if weights is None else float(weights.get(k, 0.0))) for k, v in values.items()]
    top = reduce(lambda s, p: s + F.when(p[0].isNotNull(), p[0] * p[1]).otherwise(0.0), pairs, F.lit(0.0))
    total = reduce(lambda s, p: s + F.when(p[0].isNotNull(), p[1]).otherwise(0.0), pairs, F.lit(0.0))
    return F.when(total == 0, 0.0).otherwise(top / total)


#: Weights of the parts of a composite hardness.
HARDNESS_WEIGHTS = {"score": 0.4, "similarity": 0.4, "uncertainty": 0.2}


def hardness(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Composite hardness; a single present part counts alone."""
    weights = HARDNESS_WEIGHTS if weights is None else weights
    present = reduce(lambda s, c: s + c.isNotNull().cast("int"), parts.values(), F.lit(0))
    return F.when(present == 1, F.coalesce(*parts.values())).otherwise(weighted_mean(parts, weights))


def combined_score(similarity: Column, hard: Column, similarity_weight: float = 0.5, hardness_weight: float = 0.5) -> Column:
    total = similarity_weight + hardness_weight
    return (similarity * similarity_weight + hard * hardness_weight) / total if total else F.lit(0.0)


def rubric_mean(scores: Column, weights: dict[str, float]) -> Column:
    """Weighted mean over all criteria of a map of scores; an absent criterion scores 0."""
    total = sum(weights.values())
    top = reduce(lambda s, k: s + F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)) * weights[k], weights, F.lit(0.0))
    return top / total if total else F.lit(0.0)


def ratio(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0))
