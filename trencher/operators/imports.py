"""Insert-if-absent import on three levels: parks, their restaurants, and those's dishes.

Each level asks by natural key; what is absent gets an id that is a hash of the
key, so the level below can ask before anything is written, and a second import
of the same rows finds everything there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.text import match_name
from trencher.operators import matching
from trencher.operators.storage import stored

# The confidence from which a dish is approved without review, and that of an imported record.
APPROVED_FROM, IMPORTED_CONFIDENCE = 70, 70


def _resolved(rows: DataFrame, known: DataFrame, parent: str | None, key: Column, known_key: Column, id_: str) -> DataFrame:
    """``rows`` with ``id_`` and ``new_``: the known row of this parent and key, of the least id, or a new one."""
    on = [c for c in (parent,) if c]
    there = known.select(*on, known_key.alias("key_"), F.col(id_)).where("key_ IS NOT NULL").groupBy(*on, "key_").agg(F.min(id_).alias(id_))
    asked = rows.withColumn("key_", key)
    found = asked.join(there, [*on, "key_"], "left")
    made = F.xxhash64(F.lit(id_), *[F.col(c) for c in on], "key_")
    return found.withColumn(f"new_{id_}", F.col(id_).isNull()).withColumn(id_, F.coalesce(id_, made)).drop("key_")


def _first_of_parks(rows: DataFrame, parks: DataFrame) -> DataFrame:
    """``park_key, park_id, new_park_id``: the park of least id that holds a name, whatever the case.

    A name that no park holds becomes one, unless an earlier such name holds it:
    then it finds the first of these.
    """
    asked = rows.where("park IS NOT NULL").groupBy(F.lower("park").alias("park_key")).agg(F.min("row_id").alias("first"))
    asked = stored(asked, "park_names")
    held = matching.within(asked.select(F.col("park_key").alias("name")), parks.select(F.col("park_id").alias("id"), F.col("park_name").alias("name")))
    old = held.groupBy(F.col("asked").alias("park_key")).agg(F.min("id").alias("park_id")).withColumn("new_park_id", F.lit(False))
    old = stored(old, "known_parks")
    left = stored(asked.join(old, "park_key", "left_anti"), "other_names")
    inside = matching.within(left.select(F.col("park_key").alias("name")), left.select(F.struct("first", "park_key").alias("id"), F.col("park_key").alias("name")))
    # The first name that holds one is itself held by no earlier one.
    new = inside.groupBy(F.col("asked").alias("park_key")).agg(F.min("id").alias("of")).select(
        "park_key", F.xxhash64(F.lit("park_id"), F.col("of.park_key")).alias("park_id"), F.lit(True).alias("new_park_id"))
    return old.unionByName(new)


def import_menus(rows: DataFrame, parks: DataFrame, restaurants: DataFrame, items: DataFrame, loose: bool = False) -> DataFrame:
    """``row_id, park_id, restaurant_id, item_id, new_park_id, new_restaurant_id, verdict`` for every row.

    ``rows``: ``row_id`` (their order), ``park, restaurant, name``.  Exact: all
    three by equal names.  ``loose``: a park by a name that holds the one given,
    a restaurant by its name whatever the case, a dish by its matching key.
    ``imported``: the first row of a dish that is not there; ``duplicate``: any
    other.  A row without one of the names is ``incomplete``.
    """
    whole = F.col("park").isNotNull() & F.col("restaurant").isNotNull() & F.col("name").isNotNull()
    given = rows.select("row_id", "park", "restaurant", "name")
    asked = given.where(whole)
    if loose:
        placed = asked.withColumn("park_key", F.lower("park")).join(_first_of_parks(asked, parks), "park_key").drop("park_key")
    else:
        placed = _resolved(asked, parks, None, F.col("park"), F.col("park_name"), "park_id")
    of = (lambda c: F.lower(c)) if loose else (lambda c: F.col(c))
    dish = (lambda c: match_name(F.col(c))) if loose else (lambda c: F.col(c))
    seated = _resolved(placed, restaurants, "park_id", of("restaurant"), of("restaurant_name"), "restaurant_id")
    served = _resolved(seated, items.withColumnRenamed("name", "item_name"), "restaurant_id", dish("name"), dish("item_name"), "item_id")
    served = stored(served.drop("park", "restaurant", "name"), "resolved")
    first = served.where("new_item_id").groupBy("item_id").agg(F.min("row_id").alias("row_id")).withColumn("first_", F.lit(True))
    verdict = F.when(F.col("first_"), "imported").otherwise("duplicate")
    out = served.join(first, ["item_id", "row_id"], "left").select("row_id", "park_id", "restaurant_id", "item_id", "new_park_id", "new_restaurant_id", verdict.alias("verdict"))
    none = F.lit(None)
    rest = given.where(~whole).select("row_id", *[none.cast("long").alias(c) for c in ("park_id", "restaurant_id", "item_id")],
                                      *[none.cast("boolean").alias(c) for c in ("new_park_id", "new_restaurant_id")], F.lit("incomplete").alias("verdict"))
    return out.unionByName(rest)


def inserts(rows: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """The new rows of each level: parks and restaurants as the first row that needs them spells them."""
    all_ = rows.join(verdicts, "row_id")
    first = lambda key, new, *columns: all_.where(new).groupBy(key).agg(F.min_by(F.struct(*columns), "row_id").alias("x")).select(key, "x.*")
    return {
        "parks": first("park_id", "new_park_id", F.col("park").alias("park_name")),
        "restaurants": first("restaurant_id", "new_restaurant_id", "park_id", F.col("restaurant").alias("restaurant_name"), "land"),
        "items": all_.where("verdict = 'imported'").select("item_id", "restaurant_id", "name", "description"),
    }


def approved(rows: DataFrame) -> DataFrame:
    """Adds ``approved``: sure enough, with nutrition, and not waiting for manual values; nulls are none of these."""
    sure = (F.col("confidence") >= APPROVED_FROM) & F.col("has_nutrition") & ~F.col("needs_manual")
    return rows.withColumn("approved", F.coalesce(sure, F.lit(False)))
