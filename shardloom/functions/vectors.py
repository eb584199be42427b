"""Vector and score expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: floor of the norm, so that a zero vector stays zero.
NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = NORM_FLOOR) -> Column:
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column, eps: float = NORM_FLOOR) -> Column:
    """Cosine without building the two normalised arrays."""
    scale = F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps))
    return dot(a, b) / scale


def logits(sim: Column, logit_scale: float, bias: float = 0.0) -> Column:
    """Similarity times the exponential of the stored scale, plus bias."""
    return sim * F.exp(F.lit(float(logit_scale))) + F.lit(float(bias))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_logits(x: Column, y: Column) -> Column:
    """Binary cross entropy of a logit, in the overflow-free form."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
