"""Composite score, grade, bands, annotations and trust, as single expressions.

All functions read the wide item view by column name and stay inside one
whole-stage-codegen projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trencher.functions.numeric import band, net_carbs, ratio, round_half_up, zero_if_null
from trencher.functions.rules import present
from trencher.functions.text import display_name, edges

NUTRIENTS = (
    "calories", "carbs", "fat", "sugar", "protein", "fiber", "sodium", "cholesterol", "alcohol_grams",
)

# Grade thresholds, best first.
GRADES = (("A", 85), ("B", 70), ("C", 55), ("D", 40))


def _points(x: Column, steps: list[tuple[str, float, int]], otherwise: int) -> Column:
    ops = {"<": lambda b: x < b, "<=": lambda b: x <= b, ">": lambda b: x > b, ">=": lambda b: x >= b}
    (op, bound, value), *rest = steps
    out = F.when(ops[op](bound), value)
    for op, bound, value in rest:
        out = out.when(ops[op](bound), value)
    return out.otherwise(otherwise)


def nutrition_score() -> Column:
    """0-100, weighting net carbs 40, sugar ratio 20, protein ratio 15, fiber 15, calories 10."""
    calories, carbs = F.col("calories"), F.col("carbs")
    sugar, fiber, protein = (zero_if_null(F.col(c)) for c in ("sugar", "fiber", "protein"))
    no_carbs = carbs == 0
    weighted = (
        _points(net_carbs(carbs, fiber), [("<=", 15, 100), ("<=", 30, 80), ("<=", 45, 60), ("<=", 60, 40), ("<=", 80, 20)], 0)
        * F.lit(0.4)
        + F.when(no_carbs, 100).otherwise(
            _points(ratio(sugar, carbs), [("<", 0.2, 100), ("<", 0.4, 70), ("<", 0.6, 40)], 10)
        ) * F.lit(0.2)
        + F.when(no_carbs, 100).otherwise(
            _points(ratio(protein, carbs), [(">", 1.0, 100), (">", 0.5, 75), (">", 0.25, 50)], 20)
        ) * F.lit(0.15)
        + _points(fiber, [(">=", 8, 100), (">=", 5, 75), (">=", 2, 50)], 20) * F.lit(0.15)
        + _points(calories, [("<", 300, 100), ("<", 500, 75), ("<", 700, 50)], 25) * F.lit(0.1)
    )
    penalty = F.when(zero_if_null(F.col("alcohol_grams")) > 0, 15).otherwise(0)
    return (
        F.when(calories.isNull() | carbs.isNull(), F.lit(None).cast("int"))
        .when((calories == 0) & no_carbs, 100)
        .otherwise(F.greatest(F.lit(0), round_half_up(weighted - penalty)))
    )


def grade(score: Column) -> Column:
    return band(score, [(">=", bound, letter) for letter, bound in GRADES], "F")


def severity_bands() -> dict[str, Column]:
    """Traffic-light bands per nutrient."""
    c = F.col
    return {
        "carbs_band": band(c("carbs"), [("<=", 30, "green"), ("<=", 60, "amber")], "rose"),
        "sugar_band": band(c("sugar"), [("<", 10, "green"), ("<=", 25, "amber")], "rose"),
        "calories_band": band(c("calories"), [("<", 400, "green"), ("<=", 700, "amber")], "rose"),
        "sodium_band": band(c("sodium"), [("<", 500, "green"), ("<=", 1000, "amber")], "rose"),
        "alcohol_band": band(c("alcohol_grams"), [("<=", 14, "purple"), ("<=", 28, "amber")], "rose"),
        "protein_band": band(c("protein"), [(">=", 20, "green"), (">=", 10, "amber")], "rose"),
    }


def annotations(category: Column | None = None) -> Column:
    """Ordered array of ``(text, severity)``; empty where calories or carbs are unknown."""
    category = F.col("category") if category is None else category
    calories, carbs = F.col("calories"), F.col("carbs")
    sugar, fiber, protein, fat, alcohol = (
        zero_if_null(F.col(c)) for c in ("sugar", "fiber", "protein", "fat", "alcohol_grams")
    )
    drink = category == "beverage"
    sugar_ratio = F.when(carbs > 0, ratio(sugar, carbs)).otherwise(0.0)
    protein_ratio = (
        F.when(carbs > 0, ratio(protein, carbs)).when(protein > 0, 10.0).otherwise(0.0)
    )
    high_sugar = (sugar_ratio > 0.6) & ~drink

    def note(test: Column, text: str, severity: str) -> Column:
        return F.when(test, F.struct(F.lit(text).alias("text"), F.lit(severity).alias("severity")))

    notes = present(
        note(drink & (sugar > 25), "Liquid sugar — fastest possible glucose spike", "red"),
        note((alcohol > 0) & (carbs > 30), "High carbs + alcohol — initial spike then delayed drop. Complex dosing.", "red"),
        note((alcohol > 0) & (carbs <= 30), "Contains alcohol — may cause delayed hypoglycemia. Monitor BG for 12+ hours", "red"),
        note(high_sugar, "High simple sugar — expect rapid glucose spike", "red"),
        note(~high_sugar & (sugar_ratio > 0.4) & (carbs > 40), "Moderate sugar with high carbs — bolus early", "amber"),
        note((fat > 40) & (carbs > 40), "High fat may delay carb absorption — consider extended bolus", "amber"),
        note(F.col("is_fried") & (carbs > 40) & (fat <= 40), "Fried + high carb — fat delays peak but doesn't reduce it", "amber"),
        note(protein_ratio > 0.8, "Strong protein — may blunt postprandial rise", "green"),
        note((fiber > 6) & (carbs > 50), "High fiber offsets some carb impact — watch net carbs", "teal"),
        note((fiber > 6) & (carbs <= 50), "Good fiber content — slower carb absorption", "green"),
    )
    calm = ~F.exists(notes, lambda n: n["severity"].isin("red", "amber"))
    minimal = note((carbs < 15) & (calories < 200) & calm, "Minimal glucose impact — may not need bolus", "green")
    no_impact = F.array(
        F.struct(F.lit("Zero carb — no glucose impact").alias("text"), F.lit("green").alias("severity"))
    )
    return (
        F.when(calories.isNull() | carbs.isNull(), F.slice(no_impact, 1, 0))
        .when((carbs == 0) & drink, no_impact)
        .otherwise(F.concat(notes, present(minimal)))
    )


def usable_nutrition() -> Column:
    """Some macro known, calories or carbs known, and not an unconfirmed all-zero record."""
    values = F.array(*(F.col(c) for c in NUTRIENTS))
    known = F.filter(values, lambda v: v.isNotNull())
    all_zero = (F.size(known) > 0) & F.forall(known, lambda v: v == 0)
    confirmed = (
        (F.coalesce(F.col("source"), F.lit("")) == "official") & (zero_if_null(F.col("confidence_score")) >= 70)
    ) | F.lower(display_name(F.col("name"))).rlike(edges(
        r"\b(water|unsweetened tea|black coffee|diet soda|diet coke|diet pepsi)\b"
    ))
    return (
        F.col("nutrition_id").isNotNull()
        & (F.col("calories").isNotNull() | F.col("carbs").isNotNull())
        & (~all_zero | confirmed)
    )


def trust_level() -> Column:
    return (
        F.when(F.col("nutrition_id").isNull(), "unavailable")
        .when(F.col("confidence_score") < 70, "low")
        .when(F.col("source") == "official", "verified")
        .otherwise("estimated")
    )


def quality_warnings() -> Column:
    calories, protein, sodium = (zero_if_null(F.col(c)) for c in ("calories", "protein", "sodium"))
    return present(
        F.when(protein >= 120, "Protein looks unusually high for a single menu item."),
        F.when(calories >= 2000, "Calories look unusually high for a single menu item."),
        F.when(sodium >= 3000, "Sodium looks unusually high for a single menu item."),
        F.when(
            (F.col("confidence_score") < 70) & (F.col("carbs") == 0) & (calories >= 300),
            "Zero-carb estimate is low-confidence for a substantial item.",
        ),
    )


def trust_labels() -> dict[str, Column]:
    """Display labels that go with :func:`trust_level`; the date is formatted in UTC."""
    level, warned = trust_level(), F.size(quality_warnings()) > 0
    names = {"official": "Official", "api_lookup": "API lookup", "crowdsourced": "Crowdsourced"}
    source = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    known = F.col("nutrition_id").isNotNull()
    return {
        "trust_label": F.when(level == "unavailable", "Nutrition unavailable")
        .when(level == "low", "Low-confidence estimate")
        .when(level == "verified", "Official nutrition")
        .otherwise("Estimated nutrition"),
        "source_label": F.when(known, F.try_element_at(source, F.col("source"))).otherwise("No source"),
        "confidence_label": F.when(known, F.format_string("%d%% confidence", F.col("confidence_score"))),
        "last_updated_label": F.when(
            known & F.col("nutrition_created_at").isNotNull(),
            F.concat(F.lit("Last updated "), F.date_format("nutrition_created_at", "MMM d, yyyy")),
        ),
        "caution": F.when(level == "unavailable", "This item should not be treated as zero-carb or zero-calorie.")
        .when(level == "low", "Do not dose from this value without verifying it.")
        .when(
            level == "verified",
            F.when(warned, "Some values look unusual for a single serving. Verify serving size before using them."),
        )
        .when(warned, "Some estimated values look unusual. Verify carbs and serving size before dosing.")
        .otherwise("Verify carbs before dosing."),
    }
