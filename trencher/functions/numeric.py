"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """``floor(x + 0.5)``: halves go towards +inf, also for negatives."""
    return F.floor(x + F.lit(0.5)).cast("int")


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def missing(x: Column) -> Column:
    """Null or zero, the way the imputers read a gap."""
    return x.isNull() | (x == 0)


def energy(protein: Column, carbs: Column, fat: Column) -> Column:
    """Calories implied by the macros (4/4/9 kcal per gram)."""
    return protein * 4 + carbs * 4 + fat * 9


def energy_of(prefix: str = "") -> Column:
    return energy(F.col(prefix + "protein"), F.col(prefix + "carbs"), F.col(prefix + "fat"))


def energy_nulls_zero() -> Column:
    return energy(*(zero_if_null(F.col(c)) for c in ("protein", "carbs", "fat")))


def net_carbs(carbs: Column, fiber: Column) -> Column:
    return F.greatest(F.lit(0), carbs - zero_if_null(fiber))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives null (not an ANSI error) on a zero divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def band(x: Column, steps: list[tuple[str, float, str]], otherwise: str) -> Column:
    """``[(op, bound, label), ...]`` tested in order; null in, null out."""
    tests = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b}
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for op, bound, label in steps:
        out = out.when(tests[op](bound), F.lit(label))
    return out.otherwise(F.lit(otherwise))
