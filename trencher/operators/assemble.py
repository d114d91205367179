"""Catalogue assembly: first record per item, wide and nested item views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUTRITION_FIELDS = (
    "calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium", "cholesterol",
    "alcohol_grams", "source", "confidence_score",
)


def first_nutrition(nutrition: DataFrame, key: str = "item_id", order: Sequence[str] = ("nutrition_created_at", "nutrition_id")) -> DataFrame:
    """First record per item under a total order.

    ``min_by`` combines on the map side, so one item holding a third of all
    records costs one partial row per task, where a window would pull its rows
    into a single task.
    """
    rest = [c for c in nutrition.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("best")
    return nutrition.groupBy(key).agg(best).select(key, "best.*")


def wide_items(items: DataFrame, first: DataFrame, restaurants: DataFrame, parks: DataFrame) -> DataFrame:
    """Left joins only: items without nutrition, restaurant or park stay, with nulls.

    Whether a dimension is broadcast is left to its size statistics.
    """
    places = restaurants.join(parks, "park_id", "left")
    extra = [c for c in first.columns if c not in ("order_id", "line")]
    return (
        items.join(first.select(*extra), "item_id", "left")
        .join(places, "restaurant_id", "left")
    )


def nested_items(items: DataFrame, nutrition: DataFrame, allergens: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Document form: arrays of nutrition and allergen structs per item.

    The arrays are the children of one item, bounded by the data model (an item
    has a handful of records), and ``places`` (restaurant with park) nests as a struct.
    """
    n = nutrition.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in nutrition.columns if c != "item_id"]))).alias("nutritional_data")
    )
    a = allergens.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in allergens.columns if c != "item_id"]))).alias("allergens")
    )
    out = items.join(n, "item_id", "left").join(a, "item_id", "left")
    if places is not None:
        doc = places.select("restaurant_id", F.struct(*places.columns).alias("restaurant"))
        out = out.join(doc, "restaurant_id", "left")
    return out


def restrict_to_parks(items: DataFrame, restaurants: DataFrame, park_ids: DataFrame) -> DataFrame:
    """Items of the given parks, as two semi joins."""
    chosen = restaurants.join(park_ids, "park_id", "left_semi").select("restaurant_id")
    return items.join(chosen, "restaurant_id", "left_semi")


def lookup_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items by key list; repeated and unknown keys do no harm."""
    return items.join(ids, "item_id", "left_semi")


def lacking_nutrition(items: DataFrame, nutrition: DataFrame) -> DataFrame:
    return items.join(nutrition.select("item_id"), "item_id", "left_anti")


def pending_calories(wide: DataFrame) -> DataFrame:
    """Work-list of items without a record or with null calories."""
    return wide.withColumn(
        "reason", F.when(F.col("nutrition_id").isNull(), "no_record").when(F.col("calories").isNull(), "null_calories")
    ).where("reason IS NOT NULL")
