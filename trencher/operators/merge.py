"""Merging what several sources say about the same dish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trencher.functions.text import match_name

# Trust in each source, that of others, and the relative spread of prices that is a conflict.
PRIORITY = {"official": 100, "universal": 90, "allears": 80, "touringplans": 70, "dfb": 60, "yelp": 40}
OTHER_CONFIDENCE, PRICE_SPREAD = 50, 0.15
PLACE = ("park_name", "restaurant_name", "name")
CARRIED = ("park_name", "restaurant_name", "land", "name", "description", "price", "category")


def _trust() -> Column:
    trust = F.lit(0)
    for source, value in PRIORITY.items():
        trust = F.when(F.col("source") == source, value).otherwise(trust)
    return trust


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Adds the keys of names, best where each name is one row: the merges take them as they are."""
    return df.select("*", *[match_name(F.col(c)).alias(f"{c}_key") for c in columns])


def _keys(rows: DataFrame) -> list[Column]:
    own = lambda c: F.col(f"{c}_key") if f"{c}_key" in rows.columns else match_name(F.col(c))
    return [F.coalesce(own(c), F.lit("")).alias(f"{c}_key") for c in PLACE]


def merge_sources(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per park, restaurant and dish of equal normalised names, with the columns of the most trusted source.

    ``rows``: ``source`` and the columns of ``CARRIED``; the first by ``order``
    wins among equals.  Adds ``sources`` (distinct, bounded by the vocabulary of
    sources), ``confidence`` and the prices' number, extremes and ``price_conflict``.
    A null name is an empty one; zero and null prices are none.  All
    aggregates combine on the map side, so a dish that most rows name is one
    partial row per task.
    """
    trust, keys = _trust(), _keys(rows)
    price = F.when(F.col("price") != 0, F.col("price"))
    first = F.min_by(F.struct("_trust", *CARRIED), F.struct((-F.col("_trust")).alias("t"), *order)).alias("first")
    merged = rows.withColumn("_trust", trust).groupBy(*keys).agg(
        first, F.array_sort(F.collect_set("source")).alias("sources"), F.count(price).alias("n_prices"), F.min(price).alias("lowest_price"), F.max(price).alias("highest_price"))
    spread = F.try_divide((F.col("highest_price") - F.col("lowest_price")).cast("double"), F.col("lowest_price").cast("double"))
    merged = merged.select(*[f"{c}_key" for c in PLACE], "first.*", "sources", "n_prices", "lowest_price", "highest_price",
                           F.coalesce((F.col("n_prices") >= 2) & (spread > PRICE_SPREAD), F.lit(False)).alias("price_conflict"))
    confidence = F.when(F.col("_trust") > 0, F.col("_trust")).otherwise(OTHER_CONFIDENCE)
    return merged.withColumn("confidence", confidence).withColumn("category", F.coalesce("category", F.lit("entree"))).drop("_trust")


def price_conflicts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """What each source says a dish with a price conflict costs: the dish's keys, ``at`` (from 1), ``source`` and ``price``.

    The most trusted source comes first, equals by ``order``.  One row per price
    said, so a dish that most rows name is no long list.
    """
    names = [f"{c}_key" for c in PLACE]
    said = rows.withColumn("_trust", _trust()).where("price != 0").select(*_keys(rows), "_trust", "source", F.col("price").cast("double").alias("price"), *order)
    # One shuffle and one sort give the places and the prices' spread.
    dish = Window.partitionBy(*names)
    low, high = F.min("price").over(dish), F.max("price").over(dish)
    placed = said.select(*names, F.row_number().over(dish.orderBy(F.desc("_trust"), *order)).alias("at"), "source", "price")
    apart = placed.select("*", F.count("*").over(dish).alias("n_"), F.try_divide(high - low, low).alias("spread_"))
    return apart.where((F.col("n_") >= 2) & (F.col("spread_") > PRICE_SPREAD)).drop("n_", "spread_")
