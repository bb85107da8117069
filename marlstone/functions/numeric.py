"""Numeric column functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int) -> Column:
    """Half-up rounding in double arithmetic with a slack of a millionth of a unit, so that sums added in another order round alike."""
    scale = float(10**digits)
    return F.floor(_col(x).cast("double") * scale + 0.500001) / scale


def half_even(x: str | Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def safe_log(x: str | Column) -> Column:
    """Natural logarithm, null at zero and below."""
    return F.when(_col(x) > 0, F.ln(_col(x)))


def floor_fraction(x: str | Column) -> Column:
    """What follows the point."""
    return _col(x) - F.floor(_col(x))


def has_fraction(x: str | Column) -> Column:
    """1 where a number is not whole: ceiling minus floor."""
    return (F.ceil(_col(x)) - F.floor(_col(x))).cast("int")


def cyclic(x: str | Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a period."""
    angle = _col(x) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def sigmoid(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-_col(x)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(shifted, lambda x: x / total(shifted))


def normalised(values: Column, power: int = 2) -> Column:
    """An array over its L1 or L2 norm; zeros stay."""
    norm = total(F.transform(values, F.abs)) if power == 1 else F.sqrt(total(F.transform(values, lambda x: x * x)))
    return F.transform(values, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def expected(values: Column, scores: Sequence[float]) -> tuple[Column, Column]:
    """Mean and standard deviation of scores under an array of weights."""
    marks = F.array(*[F.lit(float(s)) for s in scores])
    mass = total(values)
    mean = F.try_divide(total(F.zip_with(values, marks, lambda p, s: p * s)), mass)
    spread = F.try_divide(total(F.zip_with(values, marks, lambda p, s: p * (s - mean) * (s - mean))), mass)
    return mean, F.sqrt(spread)
