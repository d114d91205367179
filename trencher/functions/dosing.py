"""Batch dose-scoring expressions over a readings table.

Columns: ``carbs, blood_glucose, target, icr, cf`` (nullable doubles),
``activity`` (none/mod/high), ``active_insulin, max_bolus`` (nullable doubles;
null reads as "not given" and takes the default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.rules import present

# Accepted ranges and safety limits.
LIMITS = {
    "carbs": (0, 250), "blood_glucose": (40, 600), "target": (70, 180), "icr": (3, 30),
    "cf": (10, 150), "active_insulin": (0, 50), "max_bolus": (1, 50),
}
LOW_GLUCOSE, URGENT_LOW = 70, 54
DEFAULT_MAX_BOLUS, ABSOLUTE_MAX_BOLUS, UNUSUAL_DOSE = 25, 50, 15
REQUIRED = {
    "carbs": ("Enter total carbs.", "Total carbs must be between 0 and 250g.", "Total carbs"),
    "blood_glucose": ("Enter current blood glucose.", "Blood glucose must be between 40 and 600 mg/dL.", "Blood glucose"),
    "target": ("Enter target glucose.", "Target glucose must be between 70 and 180 mg/dL.", "Target glucose"),
    "icr": ("Enter your insulin-to-carb ratio.", "Insulin-to-carb ratio must be between 3 and 30 grams per unit.", "Insulin-to-carb ratio"),
    "cf": ("Enter your correction factor.", "Correction factor must be between 10 and 150 mg/dL per unit.", "Correction factor"),
}
LOW_MESSAGE = "Blood glucose is below 70 mg/dL. Treat the low before considering meal or correction insulin."


def tenths(x: Column) -> Column:
    return F.floor(x * 10 + F.lit(0.5)) / 10


def _outside(name: str, value: Column | None = None) -> Column:
    low, high = LIMITS[name]
    value = F.col(name) if value is None else value
    return (value < low) | (value > high) | F.isnan(value)


def score_doses(readings: DataFrame) -> DataFrame:
    """Adds validation status/messages, the dose breakdown and the safety triggers."""
    on_board = F.coalesce(F.col("active_insulin"), F.lit(0.0))
    cap = F.coalesce(F.col("max_bolus"), F.lit(float(DEFAULT_MAX_BOLUS)))
    glucose = F.col("blood_glucose")
    low = ~_outside("blood_glucose") & (glucose < LOW_GLUCOSE)

    notes: list[Column] = []
    for name, (ask, out_of_range, _) in REQUIRED.items():
        note = F.when(F.col(name).isNull(), ask).when(_outside(name), out_of_range)
        notes.append(note.when(low, LOW_MESSAGE) if name == "blood_glucose" else note)
    notes.append(F.when(_outside("active_insulin", on_board), "Insulin on board must be between 0 and 50 units."))
    notes.append(F.when(_outside("max_bolus", cap), "Max bolus must be between 1 and 50 units."))
    incomplete = F.greatest(*(F.col(n).isNull() for n in REQUIRED))

    df = readings.withColumn("messages", present(*notes)).withColumn(
        "validation",
        F.when(F.coalesce(low, F.lit(False)), "hypoglycemia")
        .when(F.size("messages") == 0, "valid")
        .when(incomplete, "incomplete")
        .otherwise("invalid"),
    )
    valid = F.col("validation") == "valid"
    correction = F.greatest(F.lit(0.0), F.try_divide(glucose - F.col("target"), F.col("cf")))
    df = (
        df.withColumn("_bolus", F.when(valid, F.try_divide(F.col("carbs"), F.col("icr"))))
        .withColumn("_correction", F.when(valid, correction))
        .withColumn("_offset", F.least(on_board, F.col("_correction")))
        .withColumn("_after", F.greatest(F.lit(0.0), F.col("_correction") - F.col("_offset")))
        .withColumn("_pct", F.when(F.col("activity") == "mod", 0.25).when(F.col("activity") == "high", 0.5).otherwise(0.0))
        .withColumn("_adjusted", F.col("_bolus") * (1 - F.col("_pct")))
        .withColumn("_total", F.greatest(F.lit(0.0), F.col("_adjusted") + F.col("_after")))
    )
    blocked = F.col("_total") > F.least(cap, F.lit(float(ABSOLUTE_MAX_BOLUS)))
    df = df.withColumn(
        "dose_status",
        F.when(~valid, F.lit(None).cast("string"))
        .when(blocked, "blocked")
        .when(F.col("_total") > UNUSUAL_DOSE, "warning")
        .otherwise("ok"),
    )
    for out, source in {
        "carb_bolus": "_bolus", "adjusted_carb_bolus": "_adjusted", "correction": "_correction",
        "iob_adjustment": "_offset", "correction_after_iob": "_after", "total_before_safety": "_total",
    }.items():
        df = df.withColumn(out, F.when(valid, tenths(F.col(source))))
    df = df.withColumn("suggested", F.when(valid & ~blocked, tenths(F.col("_total"))))
    df = df.withColumn("triggers", _triggers(on_board))
    df = df.withColumn("low_glucose", F.coalesce(glucose < LOW_GLUCOSE, F.lit(False)))
    df = df.withColumn("urgent_low", F.coalesce(glucose < URGENT_LOW, F.lit(False)))
    return df.drop("_bolus", "_correction", "_offset", "_after", "_pct", "_adjusted", "_total")


def _triggers(on_board: Column) -> Column:
    glucose, target, cf = F.col("blood_glucose"), F.col("target"), F.col("cf")
    absent = present(*(F.when(F.col(n).isNull(), label) for n, (_, _, label) in REQUIRED.items()))
    need = F.try_divide(glucose - target, cf)
    first = present(
        F.when(F.size(absent) > 0, F.concat(F.lit("Missing required input: "), F.array_join(absent, ", "), F.lit("."))),
        F.when(F.col("validation") == "hypoglycemia", "Blood glucose is below 70 mg/dL; treat the low before considering insulin."),
        F.when(glucose < target, "BG below target: correction insulin is suppressed."),
        F.when(
            (glucose > target) & (cf > 0) & F.col("active_insulin").isNotNull() & (F.col("active_insulin") >= need),
            "IOB exceeds correction need: correction insulin is reduced to 0 units.",
        ),
        F.when(F.col("dose_status") == "blocked", "Total would exceed Max Bolus."),
        F.when(F.col("carbs") <= 0, "Carbs <= 0: no meal-carb dose is shown."),
        F.when(
            F.coalesce(F.col("blocked_by_nutrition"), F.lit(False)),
            "Meal includes items with unavailable nutrition; totals should not feed the estimator.",
        ),
    )
    rest = F.filter(F.col("messages"), lambda m: ~m.startswith("Enter "))
    return F.array_distinct(F.concat(first, rest))
