"""Repeatable random numbers.

Every draw is a hash of the keys it belongs to, so it depends neither on partitioning nor on
retries, and another engine with ``md5`` draws the same numbers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0


def _text(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def hash_uniform(*keys) -> Column:
    """Uniform on [0, 1): first 32 bits of the md5 of the keys joined by ``|``.

    Column arguments are values, anything else is taken as a constant.
    """
    digest = F.md5(F.concat_ws("|", *[_text(k) for k in keys]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(HASH_RANGE)


def hash_order(*keys) -> Column:
    """Random order key: the whole md5, so ties need equal keys."""
    return F.md5(F.concat_ws("|", *[_text(k) for k in keys]))


def hash_uniform_py(*keys) -> float:
    """The same draw inside a Python task; keys must already be text or integers."""
    digest = hashlib.md5("|".join(str(k) for k in keys).encode()).hexdigest()
    return int(digest[:8], 16) / HASH_RANGE


# fixed values: increment and multipliers of the splitmix64 generator
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def uniform_matrix(keys: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Uniform draws for every pair (key, column), as arrays inside a task.

    Used where draws outnumber rows by far: a 64-bit mix of key and column instead of a text hash.
    """
    golden = np.uint64(GOLDEN)
    with np.errstate(over="ignore"):
        rows = _mix((keys.astype(np.uint64) + np.uint64(seed)) * golden)
        draws = _mix(rows[:, None] ^ (columns.astype(np.uint64) * golden)[None, :])
    return (draws >> np.uint64(32)) / HASH_RANGE


def poisson_steps(limit: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities P(N <= 0), P(N <= 1), ...

    Twelve steps exhaust the resolution of a 32-bit draw.
    """
    steps, total = [], 0.0
    for k in range(limit):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append(total)
    return steps


def poisson_counts(u: np.ndarray) -> np.ndarray:
    """Poisson(1) counts by inverting the distribution function at ``u``."""
    counts = np.zeros(u.shape)
    for step in poisson_steps():
        counts += u >= step
    return counts


SPLIT = 255


def _poisson_table() -> tuple[np.ndarray, np.ndarray]:
    """Counts by the first 16 bits of a draw, ``SPLIT`` where these hold a step, and the steps as 32-bit draws."""
    steps = np.array([math.ceil(step * HASH_RANGE) for step in poisson_steps()], np.int64)
    edges = np.arange((1 << 16) + 1, dtype=np.int64) << 16
    below = np.searchsorted(steps, edges, side="right")
    last = np.searchsorted(steps, edges[1:] - 1, side="right")
    return np.where(below[:-1] == last, last, SPLIT).astype(np.uint8), steps


_COUNTS, _STEPS = _poisson_table()


def poisson_matrix(keys: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """``poisson_counts(uniform_matrix(...))``, for the same draws at a small part of the time.

    A table over the first 16 bits of a draw gives its count; the few draws whose 16 bits hold a step are compared in full.
    The mix is done in place.
    """
    golden = np.uint64(GOLDEN)
    with np.errstate(over="ignore"):
        rows = _mix((keys.astype(np.uint64) + np.uint64(seed)) * golden)
        z = rows[:, None] ^ (columns.astype(np.uint64) * golden)[None, :]
        part = np.empty_like(z)
        for shift, factor in ((30, MIX_1), (27, MIX_2)):
            np.right_shift(z, np.uint64(shift), out=part)
            np.bitwise_xor(z, part, out=z)
            np.multiply(z, np.uint64(factor), out=z)
        np.right_shift(z, np.uint64(31), out=part)
        np.bitwise_xor(z, part, out=z)
    np.right_shift(z, np.uint64(48), out=part)
    counts = _COUNTS.take(part.view(np.int64), mode="clip")
    split = np.flatnonzero(counts == SPLIT)
    if len(split):
        draws = (z.ravel()[split] >> np.uint64(32)).astype(np.int64)
        counts.ravel()[split] = np.searchsorted(_STEPS, draws, side="right")
    return counts.astype(float)
