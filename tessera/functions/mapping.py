"""The logarithmic mapping between values and bins as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.codec import INT_MAX, INT_MIN, gamma_of


def sign_of(value: Column) -> Column:
    """1, 0 or -1; NaN counts as negative, as IEEE comparison makes it neither zero nor positive."""
    return F.when(F.isnan(value), -1).when(value == 0, 0).when(value > 0, 1).otherwise(-1).cast("tinyint")


def bin_index(value: Column, accuracy: float, rule: str = "ceil") -> Column:
    """The bin of a value's magnitude; 0 for zero and NaN, the last bin for infinity.

    rule: "ceil" bins as the blob function that adds a value does; "floor" is the published rule, which halves the error.
    """
    if rule not in ("ceil", "floor"):
        raise ValueError(f"rule is 'ceil' or 'floor', not {rule!r}")
    steps = F.ln(F.abs(value)) / F.ln(F.lit(gamma_of(accuracy)))
    whole = F.ceil(steps) if rule == "ceil" else F.floor(steps)
    # infinity's logarithm is beyond an int, so the bounds come before the cast
    bounded = F.greatest(F.least(whole, F.lit(INT_MAX)), F.lit(INT_MIN)).cast("int")
    return F.when(F.isnan(value) | (value == 0), 0).otherwise(bounded)


def bin_value(index: Column, gamma: Column, offset: Column) -> Column:
    """What stands for a bin."""
    return F.pow(gamma, index - offset) * (F.lit(1.0) + (F.lit(1.0) - F.lit(2.0) / (F.lit(1.0) + gamma)))
