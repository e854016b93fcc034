"""Column expressions of the survey data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_binomial(attribute: Column) -> Column:
    """A model name with ``_`` names one answer, otherwise a whole single-choice question."""
    return attribute.contains("_")


def attribute_kind(attribute: Column) -> Column:
    return F.when(is_binomial(attribute), F.lit("binomial")).otherwise(F.lit("multinomial"))


def attribute_value(value: Column) -> Column:
    """Zero-based answer code; a taxonomy row without code is the positive answer 1."""
    return F.coalesce(value - 1, F.lit(1)).cast("int")


def decode_zero_missing(code: Column) -> Column:
    """Sparse code to label: 0 means missing, k means answer k - 1."""
    return F.nullif(code, F.lit(0)) - 1


def zero_based(label: Column, kind: Column) -> Column:
    return F.when(kind == "multinomial", label - 1).otherwise(label)


def slice_value(data_slice: Column) -> Column:
    return F.split_part(data_slice, F.lit("_"), F.lit(1)).try_cast("int")


def slice_set(data_slice: Column) -> Column:
    return F.split_part(data_slice, F.lit("_"), F.lit(-1))


def iteration_of(path: Column) -> Column:
    """Number after the last ``iteration_`` of a path, null when there is none."""
    return F.regexp_extract(path, r"^.*iteration_(\d+)", 1).try_cast("int")


def model_of(path: Column) -> Column:
    """Model name from a result path ``.../<model>_predictions``."""
    return F.split_part(F.split_part(path, F.lit("/"), F.lit(-1)), F.lit("_predictions"), F.lit(1))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero denominator (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def in_bounds(value: Column, lower: Column, upper: Column) -> Column:
    return value.between(lower, upper)


def within_tolerance(a: Column, b: Column, eps: float = 0.05) -> Column:
    return F.abs(a - b) <= F.lit(eps)


def suspicious_share(production: Column, imputed: Column) -> Column:
    """Near-even in production but filled almost always: the rows worth a look."""
    # fixed values: production band and imputed limit
    return production.between(0.45, 0.55) & (imputed > 0.75)


def pair_key(attribute1, attribute2, sakey1, sakey2, svkey1, svkey2) -> Column:
    """Text key of an answer pair: ``a__b-sa__sb-va__vb``."""
    return F.concat_ws(
        "-",
        F.concat_ws("__", attribute1, attribute2),
        F.concat_ws("__", sakey1, sakey2),
        F.concat_ws("__", svkey1, svkey2),
    )


def split_pair_key(key: Column) -> dict[str, Column]:
    """The six parts of :func:`pair_key`, as text."""
    parts = {}
    for position, name in enumerate(["attribute{}", "sakey_{}", "svkey_{}"], start=1):
        block = F.split_part(key, F.lit("-"), F.lit(position))
        for side in (1, 2):
            parts[name.format(side)] = F.split_part(block, F.lit("__"), F.lit(side))
    return parts


def argmax_class(probs: Column) -> Column:
    """Index of the largest entry, the lowest one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def apply_multipliers(probs: Column, multipliers: Column) -> Column:
    """Winning class after each probability is scaled by the multiplier of its class."""
    return argmax_class(F.zip_with(probs, multipliers, lambda p, m: p * m))


def observed_wins(label: Column, prediction: Column) -> Column:
    return F.coalesce(label.cast("int"), prediction.cast("int"))


def mean_with_zeros(columns: list[Column]) -> Column:
    """Mean over all given columns, where a null counts as 0."""
    total = F.aggregate(F.array(*columns), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return total / F.lit(float(len(columns)))
