"""Figures that chains publish, matched to the items of their restaurants.

Every fourth item stands for one that a chain publishes, under a name that is spelt
differently; one chain in eight has only another name of its restaurants.
"""

from __future__ import annotations

from trencher.operators import chains
from trencher.plans.catalogue import PLACES, quoted
from trencher.plans.registry import query

_PLACE = "CASE CAST(floor(item_id / 4) AS INT) % 16 " + " ".join(f"WHEN {i} THEN {quoted(p)}" for i, p in enumerate(PLACES)) + " WHEN 14 THEN 'Corner Bistro' END"
_NAME = ("CASE CAST(floor(item_id / 4) AS INT) % 7 WHEN 0 THEN name WHEN 1 THEN concat(upper(name), ' (Large)') WHEN 2 THEN concat('Our ', name)"
         " WHEN 3 THEN concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1), ' Deluxe') WHEN 4 THEN split_part(name, ' ', 1)"
         " WHEN 5 THEN concat(split_part(name, ' ', 1), ' - ', 'Seasonal Special Plate') ELSE concat('Crunchy ', split_part(name, ' ', 2)) END")
PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[®™©]', '', 'g'), '\s*[-–—]\s*', ' ', 'g'), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: length(w) >= 3)"
A, B = _WORDS.format("asked"), _WORDS.format("known")


@query("chain_matches", f""", published AS (SELECT item_id AS chain_item_id, {_PLACE} AS chain, ['bakery', 'smokehouse'] AS aliases, {PLAIN.format(_NAME)} AS asked FROM wide WHERE item_id % 4 = 0),
own AS (SELECT DISTINCT chain, restaurant_id FROM (SELECT DISTINCT chain FROM published) JOIN restaurants ON contains(lower(restaurant_name), lower(chain))),
places AS (SELECT * FROM own UNION SELECT chain, restaurant_id FROM (SELECT DISTINCT chain, unnest(aliases) AS alias FROM published WHERE chain IS NOT NULL AND chain NOT IN (SELECT chain FROM own)) JOIN restaurants ON contains(lower(restaurant_name), alias)),
known AS (SELECT DISTINCT chain, item_id, {PLAIN.format('name')} AS known FROM wide JOIN places USING (restaurant_id)),
asked AS (SELECT DISTINCT chain, asked FROM published),
best AS (SELECT chain, asked, item_id, CASE WHEN asked = known THEN 1 WHEN contains(asked, known) OR contains(known, asked) THEN 0.9::DOUBLE
  ELSE coalesce(len(list_intersect({A}, {B}))::DOUBLE / nullif(greatest(len({A}), len({B})), 0), 0) END AS score FROM asked JOIN known USING (chain)
  QUALIFY score >= 0.5::DOUBLE AND row_number() OVER (PARTITION BY chain, asked ORDER BY score DESC, item_id) = 1),
found AS (SELECT chain_item_id, b.item_id, b.score, CASE WHEN b.item_id IS NULL THEN 'no match' WHEN w.nutrition_id IS NULL THEN 'no record' WHEN coalesce(w.confidence_score, 0) >= {chains.TRUSTED} THEN 'trusted' ELSE 'updated' END AS status
  FROM published LEFT JOIN best b USING (chain, asked) LEFT JOIN wide w ON w.item_id = b.item_id)
SELECT *, status = 'updated' AND chain_item_id = max(chain_item_id) OVER (PARTITION BY item_id, status) AS written FROM found""")
def chain_matches(cat):
    wide = cat.wide_of("item_id", "restaurant_id", "name", "nutrition_id", "confidence_score")
    published = wide.where("item_id % 4 = 0").selectExpr("item_id AS chain_item_id", f"{_PLACE} AS chain", "array('bakery', 'smokehouse') AS aliases", f"{_NAME} AS name")
    return chains.match_chains(published, cat.restaurants, wide)
