"""Scraped menus, photos and new dishes matched to the catalogue.

The scraped rows are the catalogue's own items with names, restaurants and parks
spelt differently, so every way of matching, and of not matching, has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.functions.text import spaced_name
from trencher.functions.vocab.matching import FOOD_KEYWORDS, KEYWORD_LENGTH, PHOTO_WORD_LENGTH, STOP_WORDS
from trencher.operators import resolve
from trencher.plans.catalogue import base_sql
from trencher.plans.registry import query

SCRAPED = {
    "dish_id": "item_id",
    "park": "CASE WHEN item_id % 17 = 0 THEN 'Atlantis' WHEN item_id % 3 = 0 THEN upper(park_name) WHEN item_id % 3 = 1 THEN substr(park_name, 1, 8) ELSE park_name END",
    "restaurant": "CASE item_id % 5 WHEN 0 THEN restaurant_name WHEN 1 THEN concat(upper(restaurant_name), '!') WHEN 2 THEN concat('The ', restaurant_name)"
                  " WHEN 3 THEN concat(substr(restaurant_name, 1, 2), 'o', substr(restaurant_name, 4)) ELSE concat(restaurant_name, ' at the Lagoon') END",
    "name": "CASE item_id % 8 WHEN 0 THEN name WHEN 1 THEN concat(name, ' XL') WHEN 2 THEN substr(name, 1, length(name) - 1)"
            " WHEN 3 THEN concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) WHEN 4 THEN concat('Our ', name)"
            " WHEN 5 THEN concat(substr(name, 1, 3), 'x', substr(name, 5)) WHEN 6 THEN upper(name) ELSE concat(substr(name, 1, 4), substr(name, 6), 's') END",
    "description": "CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Tried: ', name) END",
    "photo_url": "CASE WHEN item_id % 6 < 2 THEN concat('https://img.example.com/scraped/', CAST(item_id AS VARCHAR(20))) END",
}
MATCH = r"coalesce(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')), '')"
SPACED = "trim(regexp_replace(regexp_replace(lower({0}), '[''‘’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _columns(**changes: str) -> str:
    return ", ".join(f"{sql} AS {c}" for c, sql in (SCRAPED | changes).items())


def _scraped(wide, **changes: str):
    return wide.selectExpr(*[f"{sql} AS {c}" for c, sql in (SCRAPED | changes).items()])


def _score(a: str, b: str) -> str:
    words = lambda x: f"list_distinct(string_split({x}, ' '))"
    return (f"CASE WHEN {a} = {b} THEN 100 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN CAST(floor(least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) * 90) AS INT) "
            f"ELSE CAST(floor(len(list_intersect({words(a)}, {words(b)}))::DOUBLE / len(list_distinct(list_concat({words(a)}, {words(b)}))) * 80) AS INT) END")


@query("menu_matches", f""", scraped AS (SELECT dish_id, lower(park) AS park, {MATCH.format('restaurant')} AS restaurant, {MATCH.format('name')} AS name FROM (SELECT {_columns()} FROM wide)),
places AS (SELECT DISTINCT park, restaurant FROM scraped WHERE park IS NOT NULL),
known AS (SELECT restaurant_id, park_name, {MATCH.format('restaurant_name')} AS known FROM restaurants JOIN parks USING (park_id)),
place AS (SELECT park, restaurant, restaurant_id, {_score('restaurant', 'known')} AS restaurant_score FROM places JOIN known ON contains(lower(park_name), park)
  QUALIFY restaurant_score >= {resolve.RESTAURANT_FLOOR} AND row_number() OVER (PARTITION BY park, restaurant ORDER BY restaurant_score DESC, restaurant_id) = 1),
placed AS (SELECT * FROM scraped LEFT JOIN place USING (park, restaurant)),
dishes AS (SELECT restaurant_id, name, item_id, {_score('name', 'known')} AS item_score FROM (SELECT DISTINCT restaurant_id, name FROM placed WHERE restaurant_id IS NOT NULL) AS d
  JOIN (SELECT item_id, restaurant_id, {MATCH.format('name')} AS known FROM wide) USING (restaurant_id)
  QUALIFY item_score >= {resolve.ITEM_FLOOR} AND row_number() OVER (PARTITION BY restaurant_id, name ORDER BY item_score DESC, item_id) = 1)
SELECT dish_id, restaurant_id, restaurant_score, item_id, item_score, CASE WHEN item_id IS NULL THEN 'new' ELSE 'updated' END AS status FROM placed LEFT JOIN dishes USING (restaurant_id, name)""")
def menu_matches(cat):
    wide = cat.wide_of("item_id", "restaurant_id", "name", "restaurant_name", "park_name")
    return resolve.match_menus(_scraped(wide), cat.parks, cat.restaurants, wide.select("item_id", "restaurant_id", "name"))


SIMILAR = "CASE WHEN {0} = {1} THEN 1 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
#: The second stage looks in a park of this very name.
PARK = "CASE WHEN item_id % 17 = 0 THEN 'Atlantis' ELSE park_name END"


@query("menu_enrichments", f""", d AS (SELECT * FROM (SELECT {_columns(park=PARK)} FROM wide) WHERE (description <> '' OR photo_url <> '') AND park IS NOT NULL),
s AS (SELECT dish_id, park, {SPACED.format('restaurant')} AS restaurant, {SPACED.format('name')} AS name, coalesce(description <> '', false) AS has_d, coalesce(photo_url <> '', false) AS has_p FROM d),
k AS (SELECT item_id, restaurant_id, park_name AS park, {SPACED.format('restaurant_name')} AS known_restaurant, {SPACED.format('name')} AS known,
  coalesce(description <> '', false) AS described, coalesce(photo_url <> '', false) AS shown FROM wide WHERE park_name IS NOT NULL),
r AS (SELECT park, restaurant, known_restaurant, {SIMILAR.format('restaurant', 'known_restaurant')} > {resolve.RESTAURANT_ABOVE}::DOUBLE AS alike,
  contains(restaurant, known_restaurant) OR contains(known_restaurant, restaurant) AS inside FROM (SELECT DISTINCT park, restaurant FROM s) JOIN (SELECT DISTINCT park, known_restaurant FROM k) USING (park)),
places AS (SELECT park, restaurant, known_restaurant FROM r QUALIFY alike OR (inside AND NOT bool_or(alike) OVER (PARTITION BY park, restaurant))),
w AS (SELECT * FROM s WHERE (park, restaurant) IN (SELECT (park, restaurant) FROM places)),
near AS (SELECT park, name, known, {SIMILAR.format('name', 'known')} AS score FROM (SELECT DISTINCT park, name FROM w) JOIN (SELECT DISTINCT park, known FROM k) USING (park)),
own AS (SELECT park, restaurant, name, item_id, score FROM (SELECT DISTINCT park, restaurant, name FROM w) JOIN places USING (park, restaurant) JOIN k USING (park, known_restaurant) JOIN near USING (park, name, known)
  QUALIFY score > {resolve.ITEM_ABOVE}::DOUBLE AND row_number() OVER (PARTITION BY park, restaurant, name ORDER BY score DESC, item_id) = 1),
anywhere AS (SELECT park, name, item_id, score FROM near JOIN k USING (park, known) WHERE score > {resolve.PARK_ABOVE}::DOUBLE QUALIFY row_number() OVER (PARTITION BY park, name ORDER BY score DESC, item_id) = 1),
m AS (SELECT dish_id, has_d, has_p, coalesce(own.score, 0) < {resolve.SURE}::DOUBLE AND coalesce(anywhere.score, 0) > coalesce(own.score, 0) AS retried, own.item_id AS own_id, own.score AS own_score, anywhere.item_id AS any_id, anywhere.score AS any_score
  FROM w LEFT JOIN own USING (park, restaurant, name) LEFT JOIN anywhere USING (park, name)),
f AS (SELECT dish_id, has_d, has_p, CASE WHEN retried THEN any_id ELSE own_id END AS item_id, CASE WHEN retried THEN any_score ELSE own_score END AS score,
  CASE WHEN retried THEN 'park' WHEN own_id IS NOT NULL THEN 'restaurant' END AS stage FROM m)
SELECT dish_id, item_id, score, stage, coalesce(NOT described AND dish_id = min(dish_id) FILTER (has_d) OVER (PARTITION BY item_id), false) AS sets_description,
  coalesce(NOT shown AND dish_id = min(dish_id) FILTER (has_p) OVER (PARTITION BY item_id), false) AS sets_photo FROM f LEFT JOIN k USING (item_id)""")
def menu_enrichments(cat):
    wide = cat.wide_of("item_id", "restaurant_id", "name", "restaurant_name", "park_name", "description", "photo_url")
    return resolve.enrich_from_menus(_scraped(wide, park=PARK), wide)


# Items with a photo of their own stand for photos of the park; the others want one.

@query("photo_matches", base_sql().replace("WITH", "WITH RECURSIVE", 1) + f""", n AS (SELECT item_id, park_name AS park, {SPACED.format('name')} AS name, photo_url IS NOT NULL AS is_photo FROM wide WHERE park_name IS NOT NULL),
photos AS (SELECT item_id AS photo_id, park, string_split(name || CASE WHEN item_id % 2 = 0 THEN ' large' ELSE ' classic' END, ' ') AS keywords, row_number() OVER (PARTITION BY park ORDER BY item_id) AS k FROM n WHERE is_photo),
own AS (SELECT item_id, park, list_distinct(string_split(name, ' ')) AS words FROM n WHERE NOT is_photo),
scored AS (SELECT photo_id, park, k, item_id, len(list_filter(keywords, lambda w: length(w) >= {PHOTO_WORD_LENGTH} AND list_contains(words, w))) AS hits, hits / sqrt(len(words)) AS score
  FROM photos JOIN own USING (park)),
c AS (SELECT photo_id, park, k, list(item_id ORDER BY score DESC, item_id) AS choices FROM scored WHERE hits >= {resolve.PHOTO_WORDS} AND score >= {resolve.PHOTO_SCORE}::DOUBLE GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY park ORDER BY k) AS turn FROM c),
g(park, turn, photo_id, item_id, taken) AS (SELECT DISTINCT park, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM turns
  UNION ALL SELECT t.park, t.turn, t.photo_id, list_filter(t.choices, lambda x: NOT list_contains(g.taken, x))[1] AS got,
    CASE WHEN list_filter(t.choices, lambda x: NOT list_contains(g.taken, x))[1] IS NULL THEN g.taken ELSE list_append(g.taken, list_filter(t.choices, lambda x: NOT list_contains(g.taken, x))[1]) END
  FROM g JOIN turns t ON t.park = g.park AND t.turn = g.turn + 1)
SELECT photo_id, item_id, score FROM g JOIN scored USING (photo_id, item_id)""", base=False)
def photo_matches(cat):
    name = spaced_name(F.col("name"))
    rows = cat.wide_of("item_id", "name", "park_name", "photo_url").where("park_name IS NOT NULL")
    words = F.split(F.concat(name, F.when(F.col("item_id") % 2 == 0, " large").otherwise(" classic")), " ")
    photos = rows.where("photo_url IS NOT NULL").select(F.col("item_id").alias("photo_id"), F.col("park_name").alias("park"), words.alias("keywords"))
    return resolve.match_photos(photos, rows.where("photo_url IS NULL").select("item_id", F.col("park_name").alias("park"), "name"))


def _keywords(name: str) -> str:
    kinds = ", ".join(f"CASE WHEN {' OR '.join(f'contains({name}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{kind}' END" for kind, terms in FOOD_KEYWORDS.items())
    words = f"list_filter(string_split({name}, ' '), lambda w: length(w) > {KEYWORD_LENGTH} AND w NOT IN {STOP_WORDS})"
    return f"list_distinct(list_filter(list_concat([{kinds}], {words}), lambda w: w IS NOT NULL))"


MEANS = ", ".join(f"CAST(floor(sum(coalesce({c}, 0) * similarity)::DOUBLE / sum(similarity) + 0.5::DOUBLE) AS BIGINT) AS {c}" for c in resolve.ALWAYS) + ", " + ", ".join(
    f"CASE WHEN count({c}) = count(*) THEN CAST(floor(sum({c} * similarity)::DOUBLE / sum(similarity) + 0.5::DOUBLE) AS BIGINT) END AS {c}" for c in resolve.ALL_OR_NONE)
#: New dishes have no record with calories; some names are changed so that few or no neighbours are left.
NEW_NAME = "CASE WHEN item_id % 5 = 0 THEN concat('Zesty Dragonfruit ', name) WHEN item_id % 7 = 0 THEN 'Surprise Bag' ELSE name END"
NEW_CATEGORY = "CASE WHEN item_id % 3 = 0 THEN 'special' ELSE category END"


@query("neighbour_estimates", f""", raw AS (SELECT *, {MATCH.format('name')} AS plain, {MATCH.format(NEW_NAME)} AS new_plain FROM wide),
e AS (SELECT item_id, category, {', '.join((*resolve.ALWAYS, *resolve.ALL_OR_NONE))}, {_keywords('plain')} AS known FROM raw WHERE calories <> 0),
n AS (SELECT item_id AS new_id, {NEW_CATEGORY} AS category, {_keywords('new_plain')} AS asked FROM raw WHERE coalesce(calories, 0) = 0),
p AS (SELECT *, (SELECT count(*) FROM e WHERE e.category = n.category) >= {resolve.LEAST_POOL} AS own_pool FROM n),
a AS (SELECT category, own_pool, asked FROM p GROUP BY ALL),
near AS (SELECT a.category, own_pool, asked, e.* EXCLUDE (category, known), CAST(floor(len(list_intersect(asked, known))::DOUBLE / nullif(len(list_distinct(list_concat(asked, known))), 0) * 100) AS BIGINT) AS similarity
  FROM a JOIN e ON NOT own_pool OR e.category = a.category QUALIFY similarity >= {resolve.LEAST_SIMILARITY} AND row_number() OVER (PARTITION BY a.category, own_pool, asked ORDER BY similarity DESC, item_id) <= {resolve.NEIGHBOURS}),
m AS (SELECT category, own_pool, asked, {MEANS}, CAST(floor(max(similarity) * {resolve.CONFIDENCE_SHARE}::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS confidence, count(*) AS neighbours FROM near GROUP BY ALL)
SELECT new_id AS item_id, {', '.join((*resolve.ALWAYS, *resolve.ALL_OR_NONE))}, confidence, coalesce(neighbours, 0) AS neighbours, coalesce(confidence < {resolve.LEAST_CONFIDENCE}, true) AS needs_manual
FROM p LEFT JOIN m ON p.category = m.category AND p.own_pool = m.own_pool AND p.asked = m.asked""")
def neighbour_estimates(cat):
    wide = cat.wide_of("item_id", "name", "category", *resolve.ALWAYS, *resolve.ALL_OR_NONE)
    new = wide.where("coalesce(calories, 0) = 0").selectExpr("item_id", f"{NEW_NAME} AS name", f"{NEW_CATEGORY} AS category")
    return resolve.estimate_by_neighbours(new, wide)
