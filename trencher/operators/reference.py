"""Items looked up in a table of reference foods: by name, by simplified name, by description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.numeric import zero_if_null
from trencher.functions.rules import present
from trencher.functions.text import edges

# Words that a simplified name leaves out, and confidence by how near the food's calories are.
PRAISE = r"\b(house-?made|signature|artisan|hand-?crafted|premium|classic|famous|legendary|magical|enchanted|galactic|frozen|specialty)\b"
PLACES = r"\b(disney|walt|magic kingdom|epcot|hollywood|animal kingdom)\b"
NEAR, FAIR, SURE, LIKELY, DOUBTFUL, UNKNOWN = 0.2, 0.5, 85, 60, 40, 50
OVERWRITTEN, FILLED = ("sugar", "protein", "fiber", "sodium", "cholesterol"), ("calories", "carbs", "fat")
STEPS = ("name", "simplified", "description")


def simplified(name: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(name, "(?i)" + edges(PRAISE), ""), "(?i)" + edges(PLACES), "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[‘’]", "'"), r"\s{2,}", " "))


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def looked_up(wide: DataFrame, foods: DataFrame) -> DataFrame:
    """``item_id, step, food_id`` and the values after it for every item with a gap that finds a food.

    A gap is a null sugar, protein, fiber or sodium, or no calories; items without
    a record have none.  ``foods``: ``food_id, food_name`` and the nutrients; foods
    without calories are no foods, and of equal names (case and outer blanks do
    not count) the least id stands.  The first of ``STEPS`` that finds a food
    counts; a name that simplifying leaves alone is not asked twice, and null or
    empty descriptions ask nothing.  The food's ``OVERWRITTEN`` values replace the
    item's, nulls among them; ``FILLED`` ones only stand in for zeros and nulls.

    All three questions of an item meet the foods in one join, and only ids come
    out of it: no row waits with a null key for a later step.
    """
    c = F.col
    whole = c("sugar").isNotNull() & c("protein").isNotNull() & c("fiber").isNotNull() & c("sodium").isNotNull() & (zero_if_null(c("calories")) > 0)
    rows = wide.where(c("nutrition_id").isNotNull() & ~whole)
    simple = simplified(c("name"))
    ask = lambda step, key, when: F.when(when, F.struct(F.lit(step).alias("step"), _key(key).alias("key")))
    asked = present(ask(1, c("name"), c("name").isNotNull()), ask(2, simple, simple != c("name")), ask(3, c("description"), c("description") != ""))
    known = foods.where("calories <> 0 AND food_name IS NOT NULL").groupBy(_key(c("food_name")).alias("key")).agg(F.min("food_id").alias("food_id"))
    hits = rows.select("item_id", F.explode(asked).alias("asked")).select("item_id", "asked.*").join(known, "key")
    first = hits.groupBy("item_id").agg(F.min(F.struct("step", "food_id")).alias("hit")).select("item_id", "hit.*")
    values = first.join(foods.select("food_id", *[c(x).alias(f"food_{x}") for x in OVERWRITTEN + FILLED]), "food_id")
    found = rows.select("item_id", *FILLED).join(values, "item_id")
    stored, off = zero_if_null(c("calories")), F.try_divide(F.abs(c("food_calories") - c("calories")).cast("double"), c("calories").cast("double"))
    confidence = F.when(stored == 0, UNKNOWN).when(off <= NEAR, SURE).when(off <= FAIR, LIKELY).otherwise(DOUBTFUL)
    filled = [F.when(zero_if_null(c(x)) == 0, F.coalesce(f"food_{x}", x)).otherwise(c(x)).alias(x) for x in FILLED]
    step = F.element_at(F.array(*(F.lit(s) for s in STEPS)), c("step"))
    return found.select("item_id", step.alias("step"), "food_id", *filled, *[c(f"food_{x}").alias(x) for x in OVERWRITTEN], confidence.alias("confidence_score"))
