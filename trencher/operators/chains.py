"""Nutrition that a chain publishes, brought to the catalogue's items of its restaurants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.operators import matching
from trencher.operators.storage import stored

# Scores of equal and contained names, letters of a word that counts, trust from which a record stays, and that of a chain's own figures.
EQUAL, CONTAINED, LETTERS, TRUSTED, CONFIDENCE = 1.0, 0.9, 3, 85, 90
REQUIRED, OPTIONAL = ("calories", "carbs", "fat", "protein"), ("sugar", "fiber", "sodium", "cholesterol")


def plain_name(c: Column) -> Column:
    """Lower case without marks of trade, dashes and parts in brackets, white space as single spaces."""
    x = F.regexp_replace(F.lower(c), "[®™©]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*[-–—]\s*", " "), r"\s*\([^)]*\)\s*", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def restaurants_of(chains: DataFrame, restaurants: DataFrame) -> DataFrame:
    """``chain, restaurant_id``: restaurants whose name holds the chain's, whatever the case; of chains with none, those that hold one of ``aliases``.

    ``chains``: ``chain, aliases`` (an array or null), a chain as often as it likes; null names match nothing.
    """
    known = restaurants.select(F.col("restaurant_id").alias("id"), F.col("restaurant_name").alias("name")).where("name IS NOT NULL")
    named = chains.select("chain", F.col("chain").alias("name")).where("name IS NOT NULL").distinct()
    meet = lambda asked: asked.select("chain", F.lower("name").alias("asked")).join(matching.within(asked.select("name"), known), "asked").select("chain", F.col("id").alias("restaurant_id"))
    own = stored(meet(named), "chain_restaurants")
    others = chains.join(own.select("chain").distinct(), "chain", "left_anti").select("chain", F.explode("aliases").alias("name")).where("chain IS NOT NULL AND name IS NOT NULL").distinct()
    return own.unionByName(meet(others)).distinct()


def match_chains(published: DataFrame, restaurants: DataFrame, wide: DataFrame) -> DataFrame:
    """``chain_item_id, item_id, score, status`` for every published item, and whether its figures are ``written``.

    ``published``: ``chain_item_id, chain, aliases, name``.  An item of the chain's
    restaurants matches by equal names, by one holding the other, or by the share
    of the longer name's words in common, from half on; the best counts, ties to
    the least id.  ``status``: ``no match``; ``no record`` where the item has no
    nutrition; ``trusted`` where its record stays; else ``updated``.  Of several
    published items for one item the last is written.  Equal names of a chain are
    compared once.
    """
    asked = stored(published.select("chain_item_id", "chain", "aliases", plain_name(F.col("name")).alias("name_")), "published")
    of_chain = stored(restaurants_of(asked.select("chain", "aliases").distinct(), restaurants), "restaurants")
    items = wide.join(of_chain, "restaurant_id").select(F.col("chain").alias("block"), plain_name(F.col("name")).alias("name"), F.col("item_id").alias("id"))
    ids = stored(items.groupBy("block", "name").agg(F.min("id").alias("id")).where("name IS NOT NULL"), "items")
    names = asked.select(F.col("chain").alias("block"), F.col("name_").alias("name"))
    inside = matching.contained_pairs(names, ids).withColumn("score", F.when(F.col("asked") == F.col("known"), EQUAL).otherwise(CONTAINED))
    inside = stored(inside, "inside")
    pairs = inside.unionByName(matching.half_pairs(names, ids, LETTERS).withColumnRenamed("share", "score").join(inside.select("block", "asked", "known").hint("merge"), ["block", "asked", "known"], "left_anti"))
    best = matching.best_of(pairs, ids, ["block", "asked"]).toDF("chain", "name_", "item_id", "score")
    record = wide.select("item_id", F.col("nutrition_id").isNotNull().alias("has"), (F.coalesce("confidence_score", F.lit(0)) >= TRUSTED).alias("sure"))
    found = asked.join(best, ["chain", "name_"], "left").join(record, "item_id", "left")
    status = F.when(F.col("item_id").isNull(), "no match").when(~F.col("has"), "no record").when(F.col("sure"), "trusted").otherwise("updated")
    found = stored(found.select("chain_item_id", "item_id", "score", status.alias("status")), "matches")
    last = found.where("status = 'updated'").groupBy("item_id").agg(F.max("chain_item_id").alias("last"))
    return found.join(last, "item_id", "left").select("chain_item_id", "item_id", "score", "status", F.coalesce((F.col("chain_item_id") == F.col("last")) & (F.col("status") == "updated"), F.lit(False)).alias("written"))
