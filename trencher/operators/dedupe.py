"""Duplicate resolution: best copy, keep-oldest, canonical entities and merges.

Survivors are chosen with ``min_by``/``max_by`` aggregates (combined before the
shuffle), and everything that depends on a survivor joins on the row key, which
is unique, so a group holding a third of all rows stays spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.detect import display_category, section_header
from trencher.functions.text import canonical_key, clean_display, display_name, edges

CORE = ("calories", "carbs", "fat", "sugar", "protein", "fiber", "sodium", "cholesterol")


def _known(columns) -> Column:
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNotNull().cast("int")
    return out


def completeness_points() -> Column:
    """Hundredths of a point: 100 for a record, 1 per known macro, confidence/100, photo 10, text 3, price 1."""
    nutrition = F.when(
        F.col("nutrition_id").isNotNull(), 10000 + 100 * _known(CORE) + F.coalesce("confidence_score", F.lit(0))
    ).otherwise(0)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return (
        nutrition
        + F.when(filled("photo_url"), 1000).otherwise(0)
        + F.when(filled("description"), 300).otherwise(0)
        + F.when(F.col("price").isNotNull(), 100).otherwise(0)
    )


def dedupe_items(wide: DataFrame, order: str = "item_id") -> DataFrame:
    """Best copy per (park, name) key with the number of restaurants that serve it.

    Grouping first by restaurant name makes the distinct count a plain count.
    """
    keyed = wide.select(
        canonical_key(F.col("park_name")).alias("park_key"), canonical_key(F.col("name")).alias("item_key"),
        F.trim("restaurant_name").alias("place"), completeness_points().alias("points"),
        F.col(order).alias("seq"), F.struct(*wide.columns).alias("row"),
    )
    rank = F.struct(-F.col("points"), F.col("seq"))
    per_place = keyed.groupBy("park_key", "item_key", "place").agg(
        F.min_by("row", rank).alias("row"), F.min(rank).alias("rank"), F.min("seq").alias("seq")
    )
    best = per_place.groupBy("park_key", "item_key").agg(
        F.min_by("row", "rank").alias("row"),
        F.min("seq").alias("first_seen"),
        F.greatest(F.lit(1), F.count(F.when(F.col("place") != "", 1))).alias("availability_count"),
    )
    return best.select("park_key", "item_key", "row.*", "availability_count", "first_seen")


def availability(wide: DataFrame) -> DataFrame:
    """Long form of the availability list: one row per (park, item, restaurant name)."""
    return (
        wide.select(
            canonical_key(F.col("park_name")).alias("park_key"), canonical_key(F.col("name")).alias("item_key"),
            F.trim("restaurant_name").alias("restaurant"),
        )
        .where("restaurant <> ''")
        .distinct()
    )


def keep_oldest(items: DataFrame, keys: list[Column], order: list[str], row_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the oldest row of every key, and the others."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    kept = (
        items.select(*named, row_id, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min_by(row_id, F.struct(*[f"_o{i}" for i in range(len(order))], row_id)).alias(row_id))
        .select(row_id)
    )
    return items.join(kept, row_id, "left_semi"), items.join(kept, row_id, "left_anti")


def duplicate_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same restaurant, same trimmed lower-case name."""
    return keep_oldest(items, [F.col("restaurant_id"), F.lower(F.trim("name"))], ["item_id"])


def fold_duplicates(wide: DataFrame, order: str = "item_id") -> DataFrame:
    """Public clean-up: one row per (restaurant, canonical name), first row kept and
    completed from its copies, with the best nutrition among them."""
    nonzero = F.lit(0)
    for c in CORE:
        nonzero = nonzero + F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    points = F.when(
        F.col("nutrition_id").isNotNull(), 10 * _known(CORE) + 20 * nonzero + F.coalesce("confidence_score", F.lit(0))
    ).otherwise(0)
    nutrition = F.struct("nutrition_id", *CORE, "source", "confidence_score")
    rows = wide.where(~section_header(F.col("name"))).select(
        "*", canonical_key(F.col("name")).alias("item_key"), points.alias("points"), nutrition.alias("nutrition"),
        display_category().alias("shown_category"),
    )

    def first_filled(column: str) -> Column:
        usable = F.col(column).isNotNull()
        if column in ("description", "photo_url"):
            usable = usable & (F.col(column) != "")
        return F.min_by(column, F.when(usable, F.col(order))).alias(column)

    folded = rows.groupBy("restaurant_id", "item_key").agg(
        F.min(order).alias(order),
        F.min_by(display_name(F.col("name")), order).alias("name"),
        F.min_by("shown_category", order).alias("category"),
        first_filled("description"), first_filled("price"), first_filled("photo_url"),
        *(F.bool_or(c).alias(c) for c in ("is_seasonal", "is_fried", "is_vegetarian")),
        F.min_by("nutrition", F.struct(-F.col("points"), F.col(order))).alias("n"),
        F.count(F.lit(1)).alias("copies"),
    )
    return folded.select(*[c for c in folded.columns if c != "n"], "n.*")


def mark_unavailable(wide: DataFrame) -> DataFrame:
    """All-zero, low-confidence records of foods that are not zero by nature lose their values."""
    values = F.array(*(F.col(c) for c in (*CORE, "alcohol_grams")))
    known = F.filter(values, lambda v: v.isNotNull())
    legit = F.lower(F.when(clean_display(F.col("name")) == "", F.col("name")).otherwise(clean_display(F.col("name")))).rlike(edges(
        r"\b(water|black coffee|unsweetened tea|diet coke|diet pepsi|diet soda|club soda|seltzer)\b"
    ))
    hit = (
        (F.col("confidence_score") < 70) & (F.col("calories") == 0) & (F.col("carbs") == 0)
        & F.forall(known, lambda v: v == 0) & ~legit
    )
    df = wide.withColumn("marked_unavailable", F.coalesce(hit, F.lit(False)))
    return df.withColumns({
        c: F.when(F.col("marked_unavailable"), None).otherwise(F.col(c)) for c in (*CORE, "alcohol_grams")
    })


def display_parks(parks: DataFrame) -> DataFrame:
    """Shortest spelling per canonical key; first one wins ties."""
    rank = F.struct(F.length("park_name"), F.col("park_id"))
    return parks.groupBy(canonical_key(F.col("park_name")).alias("park_key")).agg(
        F.min_by(F.struct("park_id", "park_name"), rank).alias("p")
    ).select("park_key", "p.*")


def canonical_parks(parks: DataFrame, restaurants: DataFrame, key: Column) -> DataFrame:
    """``park_id -> keep_id`` for parks sharing ``key``: most restaurants, then oldest."""
    counts = restaurants.groupBy("park_id").agg(F.count(F.lit(1)).alias("n"))
    counted = parks.join(counts, "park_id", "left").select(
        "park_id", key.alias("key"), F.coalesce("n", F.lit(0)).alias("n")
    )
    keep = counted.groupBy("key").agg(
        F.min_by("park_id", F.struct(-F.col("n"), F.col("park_id"))).alias("keep_id"), F.count(F.lit(1)).alias("copies")
    )
    return counted.join(keep, "key").select("park_id", "keep_id", "copies")


def alias_mapping(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``entity_id -> keep_id`` from a literal (loser name, keeper name) table.

    ``entities``: scope, entity_id, entity_name; ``aliases``: scope, loser, keeper.
    """
    losers = entities.join(aliases, (entities.scope == aliases.scope) & (entities.entity_name == aliases.loser)).select(
        entities.scope, entities.entity_id, aliases.keeper
    )
    keepers = entities.select(
        F.col("scope").alias("ks"), F.col("entity_name").alias("kn"), F.col("entity_id").alias("keep_id")
    ).groupBy("ks", "kn").agg(F.min("keep_id").alias("keep_id"))
    return losers.join(keepers, (F.col("scope") == F.col("ks")) & (F.col("keeper") == F.col("kn"))).select("entity_id", "keep_id").where("entity_id <> keep_id")


def merge_children(children: DataFrame, mapping: DataFrame, parent: str, name: str, row_id: str) -> DataFrame:
    """Moves children to the surviving parent, once per case-insensitive name.

    Rows already under the keeper win over moved ones, then the lowest id.
    ``mapping``: ``old_id, keep_id``.
    """
    moved = children.join(mapping, children[parent] == mapping.old_id, "left").select(
        *children.columns, F.coalesce("keep_id", parent).alias("new_parent"),
        F.coalesce(F.col("keep_id") != F.col(parent), F.lit(False)).alias("was_moved"),
    )
    winners = moved.groupBy("new_parent", F.lower(F.trim(name)).alias("_name")).agg(
        F.min_by(row_id, F.struct("was_moved", row_id)).alias(row_id)
    )
    return moved.join(winners.select(row_id), row_id, "left_semi")


def rename_unless_taken(items: DataFrame, scope: str, pattern: str) -> DataFrame:
    """Strips a suffix from names unless the clean name already exists in the same scope."""
    renamed = items.where(F.col("name").rlike(edges(pattern))).withColumn("new_name", F.trim(F.regexp_replace("name", pattern, "")))
    taken = items.select(F.col(scope).alias("_s"), F.col("name").alias("_n"))
    return renamed.join(taken, (F.col(scope) == F.col("_s")) & (F.col("new_name") == F.col("_n")), "left_anti")
