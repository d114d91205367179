"""Soft validation of nutrition records: findings, but no write is refused.

The same function serves a table and a stream: it is stateless, and the item
names are joined from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.functions.rules import present
from trencher.functions.text import edges

# Names of drinks whose energy is not in their macros, and dishes that are only named after one.
DRINKS = (
    r"(?<![A-Za-z0-9_])(?:beer|ale|lager|stout|ipa|pilsner|porter)(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])(?:wine|sangria|mimosa|champagne|prosecco|bellini)(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])(?:cocktail|margarita|martini|daiquiri|mojito|paloma|mule|spritz|sour|old fashioned|negroni)(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])(?:bourbon|whiskey|vodka|rum|tequila|gin|sake|soju|mead|cider)(?![A-Za-z0-9_])",
)
DISHES = (
    r"beer[- ]batter|beer[- ]brais|beer[- ]cheese|beer[- ]bread",
    r"wine[- ]brais|wine[- ]infus|wine[- ]poach|wine[- ]reduc|wine[- ]sauce|wine[- ]glaz",
    r"root beer|butterbeer|ginger beer|birch beer",
    r"rum[- ]cake|rum[- ]glaz|rum[- ]sauce|rum[- ]infus",
)
# Shares by which stated calories may differ from the macros', and the most calories.
DEVIATION, HIGH_DEVIATION, MOST_CALORIES = 0.30, 0.50, 3000


def soft_findings(nutrition: DataFrame, items: DataFrame) -> DataFrame:
    """``nutrition_id, item_id, check_name, severity, stated, estimate, deviation_pct``, at most two rows a record.

    Records without calories, or with 0, are skipped; an item without a name is
    no drink; unknown macros have no estimate.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    any_of = lambda patterns: F.greatest(*[name.rlike(edges(p)).cast("int") for p in patterns]) == 1
    estimate = F.col("protein") * 4 + F.col("carbs") * 4 + F.col("fat") * 9
    deviation = F.abs(F.col("calories") - estimate) / F.when(estimate > 0, estimate.cast("double"))
    off = F.struct(F.lit("atwater_deviation").alias("check_name"), F.when(deviation > HIGH_DEVIATION, "HIGH").otherwise("MEDIUM").alias("severity"),
                   estimate.cast("long").alias("estimate"), F.floor(deviation * 100 + F.lit(0.5)).cast("long").alias("deviation_pct"))
    none = F.lit(None).cast("long")
    extreme = F.struct(F.lit("extreme_calories").alias("check_name"), F.lit("MEDIUM").alias("severity"), none.alias("estimate"), none.alias("deviation_pct"))
    found = present(F.when(~(any_of(DRINKS) & ~any_of(DISHES)) & (deviation > DEVIATION), off), F.when(F.col("calories") > MOST_CALORIES, extreme))
    rows = nutrition.where("calories != 0").join(items.select("item_id", "name"), "item_id", "left")
    return rows.select("nutrition_id", "item_id", F.explode(found).alias("x"), F.col("calories").cast("long").alias("stated")).select(
        "nutrition_id", "item_id", "x.check_name", "x.severity", "stated", "x.estimate", "x.deviation_pct")
