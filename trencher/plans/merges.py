"""Merges of what several sources say: lines of orders are the scraped rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.operators import merge
from trencher.plans.registry import query

SOURCES = ("official", "universal", "allears", "touringplans", "dfb", "yelp", "leaflet")
#: The source and the price (in quarters) that a record stands for.
PRICE = "CASE WHEN confidence_score % 10 = 0 THEN NULL WHEN confidence_score % 11 = 0 THEN 0 ELSE CAST(8 + (line + confidence_score) % 5 AS DOUBLE) / 4 END"
ORDER = ("order_id", "line", "item_id", "nutrition_id")
KEY = r"coalesce(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '')"


KEYED = f""", said AS (SELECT n.order_id, n.line, n.item_id, n.nutrition_id, list_extract({list(SOURCES)}, CAST((n.item_id + n.confidence_score) % 7 AS INT) + 1) AS source,
  p.park_name, r.restaurant_name, r.land, i.name, i.description, {PRICE} AS price, i.category
  FROM nutrition n JOIN items i USING (item_id) LEFT JOIN restaurants r ON r.restaurant_id = n.restaurant_id LEFT JOIN parks p ON p.park_id = r.park_id),
keyed AS (SELECT *, {', '.join(f"{KEY.format(c)} AS {c}_key" for c in merge.PLACE)},
  coalesce(map_extract(map({list(merge.PRIORITY)}, {list(merge.PRIORITY.values())}), source)[1], 0) AS trust FROM said)"""


@query("merged_sources", KEYED + f""",
best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY park_name_key, restaurant_name_key, name_key ORDER BY trust DESC, order_id, line, item_id, nutrition_id) = 1),
told AS (SELECT park_name_key, restaurant_name_key, name_key, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(nullif(price, 0)) AS n_prices,
  min(nullif(price, 0)) AS lowest_price, max(nullif(price, 0)) AS highest_price FROM keyed GROUP BY ALL)
SELECT park_name_key, restaurant_name_key, name_key, park_name, restaurant_name, land, name, description, price, coalesce(category, 'entree') AS category, sources, n_prices,
  lowest_price, highest_price, coalesce(n_prices >= 2 AND (highest_price - lowest_price) / lowest_price > 0.15::DOUBLE, false) AS price_conflict,
  CAST(CASE WHEN trust > 0 THEN trust ELSE 50 END AS INT) AS confidence FROM best JOIN told USING (park_name_key, restaurant_name_key, name_key)""")
def merged_sources(cat):
    return merge.merge_sources(_said(cat), ORDER).withColumn("sources", F.array_join("sources", ","))


def _said(cat):
    n = cat.nutrition.select(*ORDER, "restaurant_id", "confidence_score", F.expr(PRICE).alias("price"),
                             F.element_at(F.array(*map(F.lit, SOURCES)), ((F.col("item_id") + F.col("confidence_score")) % 7 + 1).cast("int")).alias("source"))
    places = merge.keyed(cat.restaurants.join(cat.parks, "park_id", "left"), "restaurant_name", "park_name")
    return n.join(merge.keyed(cat.items.select("item_id", "name", "description", "category"), "name"), "item_id").join(places, "restaurant_id", "left")


@query("price_conflicts", KEYED + """, priced AS (SELECT * FROM keyed WHERE price <> 0)
SELECT park_name_key, restaurant_name_key, name_key, CAST(row_number() OVER (PARTITION BY park_name_key, restaurant_name_key, name_key ORDER BY trust DESC, order_id, line, item_id, nutrition_id) AS INT) AS "at", source, price
FROM priced QUALIFY count(*) OVER (PARTITION BY park_name_key, restaurant_name_key, name_key) >= 2
  AND (max(price) OVER (PARTITION BY park_name_key, restaurant_name_key, name_key) - min(price) OVER (PARTITION BY park_name_key, restaurant_name_key, name_key)) / min(price) OVER (PARTITION BY park_name_key, restaurant_name_key, name_key) > 0.15::DOUBLE""")
def price_conflicts(cat):
    return merge.price_conflicts(_said(cat), ORDER)
