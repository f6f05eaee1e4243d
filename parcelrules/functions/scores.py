"""Accuracy scores and the bands reports put them in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelrules import fixed_values as fv


def field_accuracy(predicted: Column, actual: Column, tolerance: float = fv.FIELD_TOLERANCE_PERCENT) -> Column:
    """1 within the tolerance, then a linear decay to 0 at 100 % error."""
    off = F.abs(F.try_divide(predicted - actual, actual)) * 100
    return (
        F.when(predicted.isNull() & actual.isNull(), F.lit(1.0))
        .when(predicted.isNull() | actual.isNull(), F.lit(0.0))
        .when(actual == 0, F.when(predicted == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(off <= tolerance, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - off / 100.0))
    )


def strict_hit(predicted: Column, actual: Column) -> Column:
    """Both missing, or within 5 % of the expected value (zero only equals zero)."""
    near = F.try_divide(F.abs(predicted - actual), actual) <= fv.STRICT_TOLERANCE
    return F.coalesce(
        F.when(predicted.isNull() & actual.isNull(), F.lit(True))
        .when(predicted.isNull() | actual.isNull(), F.lit(False))
        .when(actual == 0, predicted == 0)
        .otherwise(near), F.lit(False))


def relative_accuracy(predicted: Column, actual: Column) -> Column:
    """|1 - |p - a| / a|; null when a side is missing or the actual value is 0."""
    return F.abs(1.0 - F.try_divide(F.abs(predicted - actual), actual))


def success_rate(successes: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(successes.cast("double"), total), F.lit(0.0))


def settled(value: Column) -> Column:
    """A mean without the last bits, which depend on the order of summation."""
    return F.round(value, 9)


def band(value: Column, bands: tuple[list, object]) -> Column:
    steps, below = bands
    value = settled(value)
    label = None
    for bound, name in steps:
        label = F.when(value >= bound, F.lit(name)) if label is None else label.when(value >= bound, F.lit(name))
    return label.otherwise(F.lit(below))


def difficulty(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("Untested")).otherwise(band(value, fv.DIFFICULTY_BANDS))


def trend_direction(change: Column) -> Column:
    change = settled(change)
    return (F.when(change.isNull(), F.lit("New")).when(change > fv.TREND_STEP, F.lit("Improving"))
            .when(change < -fv.TREND_STEP, F.lit("Declining")).otherwise(F.lit("Stable")))


def percent_text(value: Column) -> Column:
    """'75.1%': one decimal, halves up, decided on the settled value."""
    tenths = F.floor(settled(value) * 1000 + 0.5)
    return F.format_string("%d.%d%%", F.floor(tenths / 10), tenths % 10)
