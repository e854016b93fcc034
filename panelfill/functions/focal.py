"""Focal loss and its derivatives with respect to the raw score, as column expressions.

With p the predicted probability, q the probability given to the true class and a the class
weight, the loss is -a (1-q)^gamma ln q. Derivatives use dq/ds = s q (1-q), where s is +1 for
a positive row and -1 for a negative one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: clipping of probabilities, floor for the second derivative
P_MIN = 1e-15
HESSIAN_FLOOR = 1e-6


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(P_MIN)), F.lit(1.0 - P_MIN))


def true_class_probability(y: Column, p: Column) -> Column:
    """Clipped probability given to the class a row really has.

    The ``*_at`` functions take it as a column: it occurs several times in each of them, so a
    frame should hold it once rather than repeat its expression.
    """
    clipped = clip_probability(p)
    return F.when(y == 1, clipped).otherwise(1.0 - clipped)


def _weight(y: Column, alpha: float | None) -> Column:
    return F.lit(1.0) if alpha is None else F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))


def focal_loss_at(y: Column, q: Column, gamma: float, alpha: float | None = None) -> Column:
    return -_weight(y, alpha) * F.pow(1.0 - q, F.lit(float(gamma))) * F.log(q)


def focal_grad_at(y: Column, q: Column, gamma: float, alpha: float | None = None) -> Column:
    g = float(gamma)
    sign = F.when(y == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return _weight(y, alpha) * sign * F.pow(1.0 - q, F.lit(g)) * (g * q * F.log(q) + q - 1.0)


def focal_hess_at(y: Column, q: Column, gamma: float, alpha: float | None = None) -> Column:
    """Exact second derivative; it may be negative far from the optimum."""
    g = float(gamma)
    inner = g * q * F.log(q) + q - 1.0
    slope = g * F.log(q) + g + 1.0
    curved = F.pow(1.0 - q, F.lit(g)) * slope - g * F.pow(1.0 - q, F.lit(g - 1.0)) * inner
    return _weight(y, alpha) * curved * q * (1.0 - q)


def newton_hess_at(y: Column, q: Column, gamma: float, alpha: float | None = None) -> Column:
    """Second derivative kept positive, so that it can weigh a Newton step."""
    return F.greatest(focal_hess_at(y, q, gamma, alpha), F.lit(HESSIAN_FLOOR))


def focal_loss(y: Column, p: Column, gamma: float, alpha: float | None = None) -> Column:
    return focal_loss_at(y, true_class_probability(y, p), gamma, alpha)


def focal_grad(y: Column, p: Column, gamma: float, alpha: float | None = None) -> Column:
    return focal_grad_at(y, true_class_probability(y, p), gamma, alpha)


def focal_hess(y: Column, p: Column, gamma: float, alpha: float | None = None) -> Column:
    return focal_hess_at(y, true_class_probability(y, p), gamma, alpha)


def total_focal_loss(n1: float, n0: float, p: float, gamma: float, alpha: float | None = None) -> float:
    """Loss of a constant prediction for n1 positive and n0 negative rows (driver-side scalar)."""
    p = min(max(p, P_MIN), 1.0 - P_MIN)
    a1, a0 = (1.0, 1.0) if alpha is None else (alpha, 1.0 - alpha)
    return -(n1 * a1 * (1.0 - p) ** gamma * math.log(p) + n0 * a0 * p**gamma * math.log(1.0 - p))


def best_constant_score(n1: float, n0: float, gamma: float, alpha: float | None = None, steps: int = 100) -> float:
    """Log-odds of the constant probability with the least total loss.

    Without focusing this is the log of the odds; otherwise a golden-section search on (0, 1),
    which needs nothing but the two counts.
    """
    a1, a0 = (1.0, 1.0) if alpha is None else (alpha, 1.0 - alpha)
    if gamma == 0 and n1 > 0 and n0 > 0 and a1 > 0 and a0 > 0:
        return math.log(n1 * a1 / (n0 * a0))
    ratio = (math.sqrt(5.0) - 1.0) / 2.0
    low, high = 1e-9, 1.0 - 1e-9
    for _ in range(steps):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        if total_focal_loss(n1, n0, left, gamma, alpha) <= total_focal_loss(n1, n0, right, gamma, alpha):
            high = right
        else:
            low = left
    p = (low + high) / 2.0
    return math.log(p / (1.0 - p))
