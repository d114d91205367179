"""Items looked up among reference foods.

The foods are every seventh item's record under its plain name, and every
fiftieth's under its description.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.operators import reference as R
from trencher.plans.registry import query

FOOD_NAME = "CASE WHEN item_id % 50 = 0 THEN description ELSE concat(upper(name), ' ') END"
SIMPLE = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '{R.PRAISE}', '', 'gi'), '{R.PLACES}', '', 'gi'), '[‘’]', '''', 'g'), '\s{{2,}}', ' ', 'g'))"
_STEP = "CASE WHEN f1.food_id IS NOT NULL THEN 1 WHEN f2.food_id IS NOT NULL THEN 2 ELSE 3 END"


@query("reference_foods", f""", foods AS (SELECT item_id AS food_id, {FOOD_NAME} AS food_name, * FROM wide WHERE (item_id % 7 = 0 OR item_id % 50 = 0) AND nutrition_id IS NOT NULL),
usable AS (SELECT lower(trim(food_name)) AS key, min(food_id) AS food_id FROM foods WHERE calories <> 0 AND food_name IS NOT NULL GROUP BY 1),
rows_ AS (SELECT *, {SIMPLE} AS simple FROM wide WHERE nutrition_id IS NOT NULL AND NOT (sugar IS NOT NULL AND protein IS NOT NULL AND fiber IS NOT NULL AND sodium IS NOT NULL AND coalesce(calories, 0) > 0)),
hit AS (SELECT r.item_id, {_STEP} AS n, coalesce(f1.food_id, f2.food_id, f3.food_id) AS food_id FROM rows_ r LEFT JOIN usable f1 ON f1.key = lower(trim(r.name))
  LEFT JOIN usable f2 ON f2.key = lower(r.simple) AND r.simple <> r.name LEFT JOIN usable f3 ON f3.key = lower(trim(r.description)) AND r.description <> '')
SELECT r.item_id, list_extract(['name', 'simplified', 'description'], n) AS step, food_id, {', '.join(f'CASE WHEN coalesce(r.{c}, 0) = 0 THEN coalesce(f.{c}, r.{c}) ELSE r.{c} END AS {c}' for c in R.FILLED)},
  {', '.join(f'f.{c}' for c in R.OVERWRITTEN)}, CASE WHEN coalesce(r.calories, 0) = 0 THEN 50 WHEN abs(f.calories - r.calories)::DOUBLE / r.calories <= 0.2::DOUBLE THEN 85 WHEN abs(f.calories - r.calories)::DOUBLE / r.calories <= 0.5::DOUBLE THEN 60 ELSE 40 END AS confidence_score
FROM hit JOIN rows_ r USING (item_id) JOIN foods f USING (food_id)""")
def reference_foods(cat):
    foods = cat.wide.where("(item_id % 7 = 0 OR item_id % 50 = 0) AND nutrition_id IS NOT NULL").select(
        F.col("item_id").alias("food_id"), F.expr(FOOD_NAME).alias("food_name"), *R.OVERWRITTEN, *R.FILLED)
    return R.looked_up(cat.wide, foods)
