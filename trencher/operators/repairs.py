"""Repairs of macros, calories and extreme values; fix rows over the catalogue's wide view.

Each repairer reads the values before any fix; ``fixes.phased`` lets the first
one that touches a record keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trencher.functions.numeric import energy_nulls_zero, energy_of, round_half_up, zero_if_null
from trencher.functions.text import edges
from trencher.operators.fixes import capped_confidence, emit

# Confidence of a repair and of plain coffee, trusted official records, and limits.
REPAIRED, PLAIN_COFFEE, TRUSTED = 40, 80, 80
INFLATED, FAR_TOO_LOW = 1.3, 0.2
MOST_CARBS, MOST_CALORIES, MOST_FIBER, FIBER_AFTER, SUGAR_IS_CARBS = 250, 3500, 50, 15, 30
# Names of the cases.
COFFEE, NOT_PLAIN = "^(brewed )?coffee|^pike place", "latte|mocha|frappuccino|cream|sugar|syrup"
WHOLE_CHICKEN, SEAFOOD_STEW, COOKED_MEAT = "chicken dinner|half chicken|whole chicken", "bouillabaisse|seafood stew|seafood gumbo", "chicken|pork|beef|fried"
SWEETS = "cake|cookie|cupcake|brownie|donut|doughnut|candy|sundae"
SAVOURY = "burger|sandwich|wrap|pretzel|pizza|chicken|beef|pork|fish|steak|ribs|nachos|taco|burrito|fries|potato"


def _official() -> Column:
    return F.coalesce((zero_if_null(F.col("confidence_score")) >= TRUSTED) & (F.col("source") == "official"), F.lit(False))


def _text(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def inflated_macros(wide: DataFrame) -> DataFrame:
    """Macros worth 1.3 times the stated calories or more are scaled down to these; sugar beyond the new carbs becomes 30 % of them."""
    stated = wide.where(F.col("nutrition_id").isNotNull() & (F.col("calories") > 100) & ~_official() & (F.col("category") != "beverage"))
    known = stated.where(F.col("carbs").isNotNull() & F.col("fat").isNotNull() & F.col("protein").isNotNull() & (energy_of() > 0))
    scale = F.col("calories") / energy_of().cast("double")
    scaled = {c: round_half_up(F.col(c) * scale) for c in ("carbs", "fat", "protein")}
    good = (energy_of() / F.col("calories").cast("double") >= INFLATED) & (F.least(*scaled.values()) >= 0)
    sugar = F.when(F.col("sugar") > scaled["carbs"], round_half_up(scaled["carbs"] * 0.3))
    return emit(known, {**scaled, "sugar": sugar, "confidence_score": F.lit(REPAIRED)}, "inflated_macros", good)


def calorie_mismatch(wide: DataFrame) -> DataFrame:
    """Calories far below the macros, plain coffee with food's macros, meat without protein or fat: the first case that fits counts.  Unknown values are 0."""
    name, told = _text("name"), F.concat(_text("name"), F.lit(" "), _text("description"))
    calories, carbs, fat, protein = (zero_if_null(F.col(c)) for c in ("calories", "carbs", "fat", "protein"))
    estimate = energy_nulls_zero()
    of_calories = lambda share, per: round_half_up(calories * share / F.lit(per))
    low = (calories > 0) & (estimate > 0) & (calories < estimate * FAR_TOO_LOW)
    plain = name.rlike(edges(COFFEE)) & ~told.rlike(edges(NOT_PLAIN)) & ((protein > 5) | (carbs > 5) | (fat > 2))
    chicken = name.rlike(edges(WHOLE_CHICKEN)) & (protein < 15) & (calories > 400)
    stew = name.rlike(edges(SEAFOOD_STEW)) & (protein < 10) & (calories > 400)
    dry = (fat == 0) & (calories > 400) & told.rlike(edges(COOKED_MEAT))
    case = F.when(low, "calories_too_low").when(plain, "plain_coffee").when(chicken, "chicken_protein").when(stew, "seafood_protein").when(dry, "meat_fat")
    rows = wide.where(F.col("nutrition_id").isNotNull() & ((estimate >= 50) | (calories >= 50))).withColumn("case", case).where("case IS NOT NULL")
    c = F.col("case")
    zeroed = {f: F.when(c == "plain_coffee", 0) for f in ("carbs", "sugar", "fiber")}
    missing_fat = F.greatest(round_half_up((calories - carbs * 4 - protein * 4) / F.lit(9.0)), of_calories(0.3, 9.0))
    return emit(rows, {
        "calories": F.when(c == "calories_too_low", round_half_up(estimate)).when(c == "plain_coffee", 5), **zeroed,
        "fat": F.when(c == "plain_coffee", 0).when(c == "meat_fat", missing_fat),
        "protein": F.when(c == "plain_coffee", 0).when(c == "chicken_protein", of_calories(0.25, 4.0)).when(c == "seafood_protein", of_calories(0.2, 4.0)),
        "confidence_score": F.when(c == "plain_coffee", PLAIN_COFFEE).otherwise(capped_confidence(REPAIRED)),
    }, F.concat(F.lit("mismatch: "), c))


def extreme_values(wide: DataFrame) -> DataFrame:
    """Impossible carbs, calories and fiber are cut; sugar that is all of a savoury dish's carbs becomes a tenth of them."""
    name = _text("name")
    much_carbs, much_energy, much_fiber = F.col("carbs") > MOST_CARBS, F.col("calories") > MOST_CALORIES, F.col("fiber") > MOST_FIBER
    fewer = round_half_up(F.coalesce("calories", F.lit(800)) * 0.45 / F.lit(4.0))
    half = lambda c: F.when(much_energy, round_half_up(F.col(c) / F.lit(2.0)))
    share = F.when(name.rlike(edges(SWEETS)), 0.55).otherwise(0.2)
    savoury = (F.col("sugar") == F.col("carbs")) & (F.col("carbs") > SUGAR_IS_CARBS) & name.rlike(edges(SAVOURY))
    updates = {
        "carbs": F.when(much_carbs, fewer).otherwise(half("carbs")),
        "sugar": F.when(savoury, round_half_up(F.col("carbs") * 0.1)).when(much_carbs & (F.col("sugar") > fewer), round_half_up(fewer * share)).otherwise(half("sugar")),
        "calories": half("calories"), "fat": half("fat"), "protein": half("protein"), "sodium": half("sodium"),
        "fiber": F.when(much_fiber, F.least(round_half_up(F.coalesce("calories", F.lit(500)) * 0.01), F.lit(FIBER_AFTER))).otherwise(half("fiber")),
    }
    rows = wide.where(F.col("nutrition_id").isNotNull() & F.coalesce(F.greatest(*[x.cast("int") for x in (much_carbs, much_energy, much_fiber, savoury)]) == 1, F.lit(False)))
    return emit(rows, {**updates, "confidence_score": capped_confidence(REPAIRED)}, "extreme_values")


def better_choices(scored: DataFrame, most: int = 2) -> DataFrame:
    """``item_id, at, choice, score``: for each item up to ``most`` items of its restaurant with a better score, best first, ties to the least id.

    The best ``most`` of a restaurant are enough for all its items: whatever beats
    an item is beaten by at most ``most`` of them.  So restaurants are joined with
    their best, not with themselves.
    """
    place = F.row_number().over(Window.partitionBy("restaurant_id").orderBy(F.desc("score"), "item_id"))
    best = scored.where("score IS NOT NULL AND restaurant_id IS NOT NULL").select("restaurant_id", F.col("item_id").alias("choice"), "score", place.alias("at")).where(F.col("at") <= most)
    asking = scored.select("item_id", "restaurant_id", F.col("score").alias("own"))
    return asking.join(best, "restaurant_id").where(F.col("score") > F.col("own")).select("item_id", "at", "choice", "score")
