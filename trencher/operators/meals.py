"""Totals of meals, days and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.functions.scoring import grade, nutrition_score

NUTRIENTS = ("carbs", "calories", "fat", "protein", "sugar", "fiber", "sodium")
# Confidence below which an item is pointed out, and the bands of a carb goal in percent.
LOW_CONFIDENCE, NEAR_GOAL, AT_GOAL = 70, 75, 100


def _sums() -> list:
    return [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in NUTRIENTS]


def meal_totals(entries: DataFrame, meal: str = "meal_id") -> DataFrame:
    """Sums per meal (nulls as 0), ``net_carbs``, score and grade of the sums, and how many items are doubtful.

    ``entries``: one row per item of a meal, with nutrients, ``confidence_score``
    (null: trusted) and ``available``.
    """
    low = F.coalesce(F.col("confidence_score"), F.lit(100)) < LOW_CONFIDENCE
    totals = entries.groupBy(meal).agg(F.count(F.lit(1)).alias("item_count"), *_sums(), F.count_if(low).alias("low_confidence_count"),
                                       F.count_if(~F.col("available")).alias("unavailable_count"))
    totals = totals.withColumn("net_carbs", F.greatest(F.lit(0), F.col("carbs") - F.col("fiber")))
    scored = totals.withColumn("alcohol_grams", F.lit(None).cast("int")).withColumn("score", nutrition_score()).drop("alcohol_grams")
    return scored.withColumn("grade", grade(F.col("score")))


def meal_warnings(entries: DataFrame, meal: str = "meal_id", item: str = "item_id") -> DataFrame:
    """One row per meal, item and reason for doubt; rows rather than lists, so no meal is gathered."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("confidence_score"), F.lit(100)) < LOW_CONFIDENCE, "low_confidence"), F.when(~F.col("available"), "unavailable")))
    return entries.select(meal, item, F.explode(reasons).alias("reason")).distinct()


def trip_totals(entries: DataFrame, meals: DataFrame, carb_goal: int) -> DataFrame:
    """Totals at the levels meal, day and trip, and each meal's share of its carb goal.

    ``meals``: ``meal_id, trip_id, day``.  Entries are summed by meal before they
    meet their meals, and the levels combine on the map side.
    """
    sums = entries.groupBy("meal_id").agg(F.count(F.lit(1)).alias("item_count"), *_sums())
    summed = sums.join(meals, "meal_id").groupingSets(
        [["trip_id", "day", "meal_id"], ["trip_id", "day"], ["trip_id"]], "trip_id", "day", "meal_id").agg(
        F.grouping_id("trip_id", "day", "meal_id").alias("_level"), *[F.sum(c).alias(c) for c in ("item_count", *NUTRIENTS)])
    level = F.when(F.col("_level") == 0, "meal").when(F.col("_level") == 1, "day").otherwise("trip")
    share = F.floor(F.col("carbs") * 100 / F.lit(float(carb_goal)) + F.lit(0.5)) if carb_goal > 0 else F.lit(0)
    df = summed.withColumn("level", level).withColumn("carb_pct", F.when(F.col("_level") == 0, F.least(F.lit(AT_GOAL), share.cast("long"))))
    band = F.when(F.col("carb_pct") >= AT_GOAL, "red").when(F.col("carb_pct") >= NEAR_GOAL, "yellow").when(F.col("carb_pct").isNotNull(), "green")
    return df.withColumn("carb_band", band).drop("_level")
