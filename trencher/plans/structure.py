"""Queries over duplicates, the location hierarchy and catalogue statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.functions import taxonomy
from trencher.functions.text import canonical_key
from trencher.operators import aggregates, browse, dedupe, hierarchy
from trencher.plans.browse import DISPLAYED, SCORED
from trencher.plans.catalogue import quoted
from trencher.plans.registry import query

KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '''s\\b', '', 'g'), '''', '', 'g'), '\\b(universal|disney)s\\b', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g'))"
PARK_KEY = KEY.format(c="park_name")
ITEM_KEY = KEY.format(c="cleaned")
KNOWN = "(" + " + ".join(f"({c} IS NOT NULL)::INT" for c in dedupe.CORE) + ")"

# The taxonomy as rows: the checking SQL joins and ranks instead of testing in order.
TAXONOMY = ", taxonomy AS (SELECT * FROM (VALUES " + ", ".join(
    f"({r['resort_no']}, {quoted(r['resort_id'])}, {quoted(r['resort_name'])}, {quoted(r['resort_location'])}, {r['category_no']}, {quoted(r['category_id'])},"
    f" {quoted(r['category_label'])}, {r['venue_no']}, {quoted(r['pattern'])}, {r['seasonal']})"
    for r in sorted(taxonomy.flat_patterns(), key=lambda r: r["pattern"])
) + """) t(resort_no, resort_id, resort_name, resort_location, category_no, category_id, category_label, venue_no, pattern, seasonal)),
placed AS (SELECT park_id, t.* FROM parks JOIN taxonomy t ON contains(lower(park_name), t.pattern)
  QUALIFY row_number() OVER (PARTITION BY park_id ORDER BY resort_no, length(pattern) DESC, category_no) = 1),
venue AS (SELECT p.park_id, min(t.venue_no) AS venue_no FROM parks p JOIN placed c USING (park_id)
  JOIN taxonomy t ON t.resort_id = c.resort_id AND t.category_id = c.category_id AND contains(lower(p.park_name), t.pattern) GROUP BY 1)
"""
COUNTS = """, counts AS (SELECT park_id, sum(coalesce(n, 0))::BIGINT AS item_count FROM restaurants
  LEFT JOIN (SELECT restaurant_id, count(*) n FROM wide GROUP BY 1) USING (restaurant_id) WHERE park_id IS NOT NULL GROUP BY 1)"""


@query("best_copies", DISPLAYED + f""", keyed AS (SELECT *, {PARK_KEY} AS park_key, {ITEM_KEY} AS item_key,
 (CASE WHEN nutrition_id IS NOT NULL THEN 100 + {KNOWN} + coalesce(confidence_score, 0) / 100.0 ELSE 0 END) + (CASE WHEN photo_url <> '' THEN 10 ELSE 0 END)
 + (CASE WHEN description <> '' THEN 3 ELSE 0 END) + (CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) AS pts FROM shown)
SELECT park_key, item_key, arg_min(item_id, (-round(pts * 100)::BIGINT) * 1000000000 + item_id) AS item_id, min(item_id) AS first_seen,
 greatest(1, count(DISTINCT nullif(trim(restaurant_name), '')))::BIGINT AS availability_count FROM keyed GROUP BY ALL""")
def best_copies(cat):
    return dedupe.dedupe_items(cat.wide).select("park_key", "item_key", "item_id", "first_seen", F.col("availability_count").cast("bigint").alias("availability_count"))


@query("text_lookup", SCORED + f""", keyed AS (SELECT *, {PARK_KEY} AS park_key, {ITEM_KEY} AS item_key,
 (CASE WHEN nutrition_id IS NOT NULL THEN 100 + {KNOWN} + coalesce(confidence_score, 0) / 100.0 ELSE 0 END) + (CASE WHEN photo_url <> '' THEN 10 ELSE 0 END)
 + (CASE WHEN description <> '' THEN 3 ELSE 0 END) + (CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) AS pts FROM scored
 WHERE NOT is_header AND (contains(lower(name), 'ch') OR contains(lower(description), 'ch'))),
best AS (SELECT arg_min(item_id, (-round(pts * 100)::BIGINT) * 1000000000 + item_id) AS item_id FROM keyed GROUP BY park_key, item_key)
SELECT item_id, name FROM keyed SEMI JOIN best USING (item_id) ORDER BY name, item_id LIMIT 50""")
def text_lookup(cat):
    return browse.text_lookup(cat.wide, "CH").select("item_id", "name")


@query("availability", DISPLAYED + f"SELECT DISTINCT {PARK_KEY} AS park_key, {ITEM_KEY} AS item_key, trim(restaurant_name) AS restaurant FROM shown WHERE trim(restaurant_name) <> ''")
def availability(cat):
    return dedupe.availability(cat.wide)


@query("duplicate_items_removed", """SELECT item_id, restaurant_id, name FROM wide QUALIFY row_number() OVER (PARTITION BY restaurant_id, lower(trim(name)) ORDER BY item_id) > 1""")
def duplicate_items_removed(cat):
    return dedupe.duplicate_items(cat.wide)[1].select("item_id", "restaurant_id", "name")


NONZERO = "(" + " + ".join(f"coalesce(({c} > 0)::INT, 0)" for c in dedupe.CORE) + ")"


@query("folded_duplicates", SCORED + f""", k AS (SELECT *, {ITEM_KEY} AS item_key,
  CASE WHEN nutrition_id IS NOT NULL THEN 10 * {KNOWN} + 20 * {NONZERO} + coalesce(confidence_score, 0) ELSE 0 END AS pts FROM scored WHERE NOT is_header)
SELECT restaurant_id, item_key, min(item_id) AS item_id, arg_min(display_name, item_id) AS name, arg_min(display_category, item_id) AS category,
  arg_min(description, item_id) FILTER (description <> '') AS description, arg_min(price, item_id) FILTER (price IS NOT NULL) AS price, bool_or(is_fried) AS is_fried,
  first(nutrition_id ORDER BY pts DESC, item_id) AS nutrition_id, count(*) AS copies FROM k GROUP BY restaurant_id, item_key""")
def folded_duplicates(cat):
    return dedupe.fold_duplicates(cat.wide).select(
        "restaurant_id", "item_key", "item_id", "name", "category", "description", "price", "is_fried", "nutrition_id", "copies")


@query("nutrition_marked_unavailable", DISPLAYED + """SELECT item_id, name FROM shown WHERE confidence_score < 70 AND calories = 0 AND carbs = 0 AND coalesce(fat, 0) = 0
  AND coalesce(sugar, 0) = 0 AND coalesce(protein, 0) = 0 AND coalesce(fiber, 0) = 0 AND coalesce(sodium, 0) = 0 AND coalesce(cholesterol, 0) = 0 AND coalesce(alcohol_grams, 0) = 0
  AND NOT regexp_matches(lower(display_name), '\\b(water|black coffee|unsweetened tea|diet coke|diet pepsi|diet soda|club soda|seltzer)\\b')""".replace("\\\\", "\\"))
def nutrition_marked_unavailable(cat):
    return dedupe.mark_unavailable(cat.wide).where("marked_unavailable").select("item_id", "name")


@query("display_parks", f"""SELECT {PARK_KEY} AS park_key, arg_min(park_id, length(park_name) * 1000 + park_id) AS park_id, arg_min(park_name, length(park_name) * 1000 + park_id) AS park_name FROM parks GROUP BY 1""")
def display_parks(cat):
    return dedupe.display_parks(cat.parks)


@query("canonical_parks", f""", n AS (SELECT p.park_id, {PARK_KEY} AS k, count(r.restaurant_id) AS n FROM parks p LEFT JOIN restaurants r USING (park_id) GROUP BY ALL)
SELECT park_id, first_value(park_id) OVER (PARTITION BY k ORDER BY n DESC, park_id) AS keep_id, count(*) OVER (PARTITION BY k) AS copies FROM n""")
def canonical_parks(cat):
    return dedupe.canonical_parks(cat.parks, cat.restaurants, canonical_key(F.col("park_name")))


@query("merged_park_restaurants", f""", n AS (SELECT p.park_id, {PARK_KEY} AS k, count(r.restaurant_id) AS n FROM parks p LEFT JOIN restaurants r USING (park_id) GROUP BY ALL),
 m AS (SELECT park_id, first_value(park_id) OVER (PARTITION BY k ORDER BY n DESC, park_id) AS keep_id FROM n)
 SELECT restaurant_id, restaurant_name, keep_id AS park_id FROM restaurants JOIN m USING (park_id)
 QUALIFY row_number() OVER (PARTITION BY keep_id, lower(trim(restaurant_name)) ORDER BY keep_id <> park_id, restaurant_id) = 1""")
def merged_park_restaurants(cat):
    mapping = dedupe.canonical_parks(cat.parks, cat.restaurants, canonical_key(F.col("park_name"))).select(
        F.col("park_id").alias("old_id"), "keep_id")
    return dedupe.merge_children(cat.restaurants, mapping, "park_id", "restaurant_name", "restaurant_id").select(
        "restaurant_id", "restaurant_name", F.col("new_parent").alias("park_id"))


@query("alias_merged_items", """, a AS (SELECT l.restaurant_id AS old_id, min(k.restaurant_id) AS keep_id FROM restaurants l JOIN restaurants k ON l.park_id = k.park_id
  AND l.restaurant_name = 'Cafe 3' AND k.restaurant_name = 'Bakery 9' GROUP BY 1), m AS (SELECT w.item_id, name, coalesce(keep_id, restaurant_id) AS restaurant_id, keep_id IS NOT NULL AS moved FROM wide w LEFT JOIN a ON old_id = restaurant_id)
  SELECT item_id, name, restaurant_id FROM m QUALIFY row_number() OVER (PARTITION BY restaurant_id, lower(trim(name)) ORDER BY moved, item_id) = 1""")
def alias_merged_items(cat):
    """Merge by a literal alias table (loser name, keeper name) inside each park."""
    places = cat.restaurants.select(F.col("park_id").alias("scope"), F.col("restaurant_id").alias("entity_id"), F.col("restaurant_name").alias("entity_name"))
    aliases = cat.parks.select(F.col("park_id").alias("scope"), F.lit("Cafe 3").alias("loser"), F.lit("Bakery 9").alias("keeper"))
    mapping = dedupe.alias_mapping(places, aliases).select(F.col("entity_id").alias("old_id"), "keep_id")
    return dedupe.merge_children(cat.wide.select("item_id", "name", "restaurant_id"), mapping, "restaurant_id", "name", "item_id").select(
        "item_id", "name", F.col("new_parent").alias("restaurant_id"))


@query("suffix_renames", r""", r AS (SELECT *, trim(regexp_replace(name, '\s*(Platter|Bowl)$', '')) AS new_name FROM wide WHERE regexp_matches(name, '\s*(Platter|Bowl)$'))
 SELECT item_id, name, new_name FROM r WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.park_id = r.park_id AND w.name = r.new_name)""")
def suffix_renames(cat):
    return dedupe.rename_unless_taken(cat.wide, "park_id", r"\s*(Platter|Bowl)$").select("item_id", "name", "new_name")


# --- hierarchy ---------------------------------------------------------------------

@query("park_taxonomy", TAXONOMY + """SELECT p.park_id, coalesce(resort_id, 'other') AS resort_id, coalesce(category_id, 'destinations') AS category_id, coalesce(venue_no, 2147483647) AS venue_no
 FROM parks p LEFT JOIN placed USING (park_id)""".replace("coalesce(venue_no", "coalesce(v.venue_no").replace("LEFT JOIN placed USING (park_id)", "LEFT JOIN placed c USING (park_id) LEFT JOIN venue v USING (park_id)"))
def park_taxonomy(cat):
    where = taxonomy.classify(F.col("park_name"), {"resort_id": "other", "category_id": "destinations"})
    return cat.parks.withColumns(where).select(
        "park_id", "resort_id", "category_id",
        taxonomy.venue_position(F.col("park_name"), F.col("resort_id"), F.col("category_id")).alias("venue_no"))


@query("location_counts", TAXONOMY + f""", l AS (SELECT coalesce(resort_id, 'other') AS resort_id, coalesce(category_id, 'destinations') AS category_id,
  'venue-' || replace(CASE WHEN park_name IS NULL THEN 'unknown-destination' ELSE {PARK_KEY} END, ' ', '-') AS venue_id,
  coalesce(nullif(trim(land), ''), 'Dining Locations') AS area, coalesce(nullif(trim(restaurant_name), ''), 'Unknown Restaurant') AS place, restaurant_id FROM wide LEFT JOIN placed USING (park_id)),
k AS (SELECT *, venue_id || ':' || replace(lower(area), ' ', '-') AS area_id FROM l), f AS (SELECT *, coalesce(CAST(restaurant_id AS VARCHAR), area_id || ':' || replace(lower(place), ' ', '-')) AS place_id FROM k)
SELECT 1 AS level, resort_id, NULL AS category_id, NULL AS venue_id, NULL AS area_id, NULL AS place_id, count(*) AS item_count FROM f GROUP BY ALL
UNION ALL SELECT 2, resort_id, category_id, NULL, NULL, NULL, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 3, resort_id, category_id, venue_id, NULL, NULL, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 4, resort_id, category_id, venue_id, area_id, NULL, count(*) FROM f GROUP BY ALL
UNION ALL SELECT 5, resort_id, category_id, venue_id, area_id, place_id, count(*) FROM f GROUP BY ALL""")
def location_counts(cat):
    return hierarchy.location_counts(cat.wide).select("level", "resort_id", "category_id", "venue_id", "area_id", "place_id", "item_count")


@query("location_nodes_in_order")
def location_nodes_in_order(cat):
    return hierarchy.ordered_nodes(hierarchy.location_counts(cat.wide)).select(
        "level", "resort_name", "category_label", "venue_name", "area_name", "place_name", "item_count")


@query("items_per_park", COUNTS + "SELECT park_id, item_count FROM counts")
def items_per_park(cat):
    return hierarchy.items_per_park(cat.restaurants, cat.wide)


@query("catalogue_counts", """SELECT (SELECT count(*) FROM parks) AS parks, (SELECT count(*) FROM restaurants) AS restaurants, (SELECT count(*) FROM items) AS items""")
def catalogue_counts(cat):
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n)).withColumn("k", F.lit(1))
    return one(cat.parks, "parks").join(one(cat.restaurants, "restaurants"), "k").join(one(cat.items, "items"), "k").drop("k")


@query("home_groups", TAXONOMY + COUNTS + """SELECT p.park_id, coalesce(resort_id, 'other') AS resort_id, coalesce(category_label, 'Additional Locations') AS category_label, coalesce(item_count, 0) AS item_count
 FROM parks p LEFT JOIN placed USING (park_id) LEFT JOIN counts USING (park_id) WHERE NOT (SELECT bool_or(item_count > 0) FROM counts) OR item_count IS NULL OR item_count > 0""")
def home_groups(cat):
    counts = hierarchy.items_per_park(cat.restaurants, cat.wide)
    return hierarchy.home_groups(cat.parks, counts).select("park_id", "resort_id", "category_label", "item_count")


@query("resort_category_counts", TAXONOMY + COUNTS + """SELECT resort_id, category_id, sum(item_count)::BIGINT AS item_count FROM (
 SELECT DISTINCT t.resort_id, t.category_id, p.park_id FROM parks p JOIN taxonomy t ON contains(lower(park_name), pattern) WHERE NOT seasonal) JOIN counts USING (park_id) GROUP BY ALL""")
def resort_category_counts(cat):
    return hierarchy.category_counts(cat.parks, hierarchy.items_per_park(cat.restaurants, cat.wide))


@query("sections", "SELECT park_id, coalesce(nullif(land, ''), 'Other Areas') AS land, restaurant_id, count(*) AS item_count FROM wide GROUP BY ALL")
def sections(cat):
    return hierarchy.group_sizes(cat.wide)


PREVIEW = TAXONOMY.replace("FROM parks JOIN taxonomy", "FROM named JOIN taxonomy").replace(
    ", taxonomy AS", ", named AS (SELECT park_id, CASE WHEN lower(trim(park_name)) = 'magic kingdom' THEN 'Magic Kingdom Park' ELSE park_name END AS park_name FROM parks), taxonomy AS", 1)


@query("catalogue_preview", PREVIEW + """SELECT trim(regexp_replace(replace(lower(n.park_name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS id, n.park_name AS name, coalesce(p.resort_id, 'other') AS resort_id, coalesce(p.category_id, 'destinations') AS category_id,
  count(*) AS item_count, count(DISTINCT (land, restaurant_name)) AS restaurant_count, array_to_string(list_sort(list_distinct(list(land))), '|') AS lands
  FROM wide w JOIN named n USING (park_id) LEFT JOIN placed p USING (park_id) GROUP BY ALL""")
def catalogue_preview(cat):
    rows = cat.wide.where("park_id IS NOT NULL").select("park_name", "land", "restaurant_name")
    return hierarchy.catalogue_preview(rows).select("id", "name", "resort_id", "category_id", "item_count", "restaurant_count", "lands")


@query("preview_totals", """SELECT count(*) AS total_items, count(DISTINCT (park_id, land, restaurant_name)) AS total_restaurants, count(DISTINCT park_id) AS total_destinations FROM wide WHERE park_id IS NOT NULL""")
def preview_totals(cat):
    rows = cat.wide.where("park_id IS NOT NULL").select("park_name", "land", "restaurant_name")
    return hierarchy.preview_totals(hierarchy.catalogue_preview(rows))


# --- statistics -----------------------------------------------------------------------

PROFILE = ", ".join(aggregates.PROFILE)


@query("shared_profiles", f"""SELECT restaurant_id, {PROFILE}, count(*) AS items, count(DISTINCT category) AS categories, arg_min(source, item_id) AS source
  FROM wide WHERE calories IS NOT NULL AND calories <> 0 GROUP BY restaurant_id, {PROFILE} HAVING count(*) >= 2 AND calories > 10""")
def shared_profiles(cat):
    return aggregates.shared_profiles(cat.wide, at_least=2).select("restaurant_id", *aggregates.PROFILE, "items", F.col("categories").cast("bigint").alias("categories"), "source")


COARSE = """, coarse AS (SELECT * REPLACE (CAST(floor(calories / 200) * 200 AS INT) AS calories, NULL::INT AS carbs, NULL::INT AS fat, NULL::INT AS protein, NULL::INT AS sugar, NULL::INT AS sodium) FROM wide)"""


def _coarse(wide):
    """Rounded energy so that profiles do repeat at every scale factor."""
    blank = {c: F.lit(None).cast("int") for c in aggregates.PROFILE if c != "calories"}
    return wide.withColumns({"calories": (F.floor(F.col("calories") / 200) * 200).cast("int"), **blank})


@query("shared_profile_rollups", COARSE + f""", g AS (SELECT restaurant_id, {PROFILE}, count(*) AS items, count(DISTINCT category) AS categories, arg_min(source, item_id) AS source,
  arg_min(park_name, item_id) AS park_name, arg_min(confidence_score, item_id) AS conf FROM coarse WHERE calories <> 0 GROUP BY restaurant_id, {PROFILE} HAVING count(*) >= 3 AND calories > 10),
 m AS (SELECT *, CASE WHEN categories >= 3 THEN items ELSE 0 END mc, CASE WHEN conf >= 60 THEN items ELSE 0 END hc, CASE WHEN conf <= 40 THEN items ELSE 0 END lc FROM g)
 SELECT kind, key, count(*) AS groups, sum(items)::BIGINT AS items, sum(mc)::BIGINT AS mixed_category, sum(hc)::BIGINT AS high_confidence, sum(lc)::BIGINT AS low_confidence FROM (
  SELECT 'park' AS kind, park_name AS key, * FROM m UNION ALL SELECT 'source', source, * FROM m UNION ALL SELECT 'confidence', CAST(conf AS VARCHAR), * FROM m UNION ALL SELECT 'total', NULL, * FROM m) GROUP BY kind, key""")
def shared_profile_rollups(cat):
    return aggregates.shared_profile_rollups(aggregates.shared_profiles(_coarse(cat.wide)))


@query("global_profiles", COARSE + f"""SELECT {PROFILE}, count(*) AS items, count(DISTINCT regexp_replace(lower(name), '[^a-z]', '', 'g')) AS labels, min(item_id) AS first_item,
 CASE WHEN count(*) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM coarse WHERE calories <> 0 GROUP BY {PROFILE} HAVING count(*) >= 2 AND count(DISTINCT regexp_replace(lower(name), '[^a-z]', '', 'g')) > 1""")
def global_profiles(cat):
    return aggregates.global_profiles(_coarse(cat.wide))


@query("shared_energy_profiles", COARSE + f""", u AS (SELECT * FROM coarse WHERE calories <> 0 AND NOT (category = 'beverage' AND regexp_matches(lower(trim(name)), '{aggregates.GENERIC_DRINKS}'))),
 g AS (SELECT calories, count(*) AS items FROM u GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT array_to_string(string_split(trim(regexp_replace(lower(name), 'customized bowl:?\\s*', '', 'g')), ' ')[1:3], ' ')) > 2)
 SELECT item_id, name, items - 1 AS others FROM u JOIN g USING (calories)""".replace("\\\\", "\\"))
def shared_energy_profiles(cat):
    return aggregates.shared_energy_profiles(_coarse(cat.wide)).select("item_id", "name", "others")


@query("restaurant_profiles", COARSE + """, g AS (SELECT restaurant_name, calories, count(*) AS items FROM coarse WHERE calories > 0 GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT name) >= 2)
 SELECT item_id, restaurant_name, items - 1 AS others FROM coarse JOIN g USING (restaurant_name, calories)""")
def restaurant_profiles(cat):
    return aggregates.restaurant_profiles(_coarse(cat.wide)).select("item_id", "restaurant_name", "others")


@query("duplicate_names", "SELECT restaurant_id, lower(trim(name)) AS name_key, count(*) AS copies, min(item_id) AS first_item FROM wide GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(cat):
    return aggregates.duplicate_names(cat.wide)


@query("duplicate_parks", f"SELECT {PARK_KEY} AS park_key, count(*) AS copies, min(park_id) AS first_park FROM parks GROUP BY 1 HAVING count(*) > 1")
def duplicate_parks(cat):
    return aggregates.duplicate_parks(cat.parks, canonical_key(F.col("park_name")))


@query("missing_by_park", """SELECT * FROM (SELECT coalesce(park_name, 'Unknown') AS park, count(*) AS total, count(*) FILTER (calories IS NULL) AS missing_nutrition, count(*) FILTER (sodium IS NULL) AS missing_sodium,
  count(*) FILTER (sugar IS NULL) AS missing_sugar, count(*) FILTER (protein = 0 AND calories > 200 AND category NOT IN ('dessert', 'beverage')) AS zero_protein, count(*) FILTER (price IS NULL) AS missing_price FROM wide GROUP BY 1)
 WHERE missing_nutrition > 0 OR missing_sodium > total * 0.3 OR missing_sugar > total * 0.3 OR zero_protein > 3""")
def missing_by_park(cat):
    return aggregates.missing_by_park(cat.wide)


@query("gaps_by_park", """SELECT * FROM (SELECT coalesce(park_name, 'Unknown') AS park, count(*) AS total, floor(count(*) FILTER (coalesce(sodium, 0) = 0)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS sodium_missing_pct,
 floor(count(*) FILTER (coalesce(sugar, 0) = 0)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS sugar_missing_pct, floor(count(*) FILTER (coalesce(protein, 0) = 0)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS protein_missing_pct
 FROM wide WHERE nutrition_id IS NOT NULL GROUP BY 1) WHERE greatest(sodium_missing_pct, sugar_missing_pct, protein_missing_pct) > 20""")
def gaps_by_park(cat):
    return aggregates.gaps_by_park(cat.wide, over=20)


@query("coverage", """SELECT count(*) AS total, count(*) FILTER (calories > 0) AS with_calories, count(carbs) AS with_carbs, count(protein) AS with_protein, count(fat) AS with_fat,
 count(sugar) AS with_sugar, count(fiber) AS with_fiber, count(sodium) AS with_sodium FROM nutrition""")
def coverage(cat):
    return aggregates.coverage(cat.nutrition)


@query("source_and_confidence", """SELECT source, CASE WHEN confidence_score >= 70 THEN '70+' WHEN confidence_score >= 50 THEN '50-69' WHEN confidence_score >= 40 THEN '40-49' WHEN confidence_score >= 30 THEN '30-39' WHEN confidence_score IS NULL THEN 'null' ELSE '<30' END AS bucket, count(*) AS records FROM nutrition GROUP BY ALL""")
def source_and_confidence(cat):
    return aggregates.source_and_confidence(cat.nutrition)


@query("gap_reasons", """SELECT reason, category, count(*) AS items FROM (
 SELECT category, CASE WHEN coalesce(carbs, 0) = 0 THEN 'sugar: no carbs data' ELSE 'sugar: has carbs but no sugar estimate' END AS reason FROM wide WHERE calories > 0 AND coalesce(sugar, 0) = 0
 UNION ALL SELECT category, 'protein' FROM wide WHERE calories > 0 AND coalesce(protein, 0) = 0 UNION ALL SELECT category, 'fiber' FROM wide WHERE carbs > 0 AND coalesce(fiber, 0) = 0
 UNION ALL SELECT category, 'sodium' FROM wide WHERE calories > 0 AND coalesce(sodium, 0) = 0) GROUP BY ALL""")
def gap_reasons(cat):
    return aggregates.gap_reasons(cat.wide)


@query("allergen_counts", """SELECT allergen_type, count(*) FILTER (severity = 'contains') AS contains, count(*) FILTER (severity = 'may_contain') AS may_contain, count(*) AS total FROM allergens GROUP BY 1""")
def allergen_counts(cat):
    return aggregates.allergen_counts(cat.allergens)


@query("allergens_per_item", "SELECT n AS n_allergens, count(*) AS items FROM (SELECT item_id, count(*) AS n FROM allergens GROUP BY 1) GROUP BY 1")
def allergens_per_item(cat):
    return aggregates.allergens_per_item(cat.allergens)


PLACE_CHAINS = (("taproom", "Taprooms", False), ("bakery|sweet shop", "Bakeries", True), ("bar", "Bars", False), ("cafe", "Cafes", True))


@query("chain_coverage", """, c(p, chain, has_official) AS (VALUES ('taproom', 'Taprooms', false), ('bakery|sweet shop', 'Bakeries', true), ('bar', 'Bars', false), ('cafe', 'Cafes', true))
 SELECT chain, has_official, count(DISTINCT r.restaurant_id) AS locations, count(w.item_id) AS items, count(w.item_id) FILTER (confidence_score < 70) AS upgradeable
 FROM c JOIN restaurants r ON regexp_matches(lower(r.restaurant_name), p) LEFT JOIN wide w ON w.restaurant_id = r.restaurant_id GROUP BY ALL""")
def chain_coverage(cat):
    return aggregates.chain_coverage(cat.wide, cat.restaurants, PLACE_CHAINS)


@query("sigma_outliers", """, s AS (SELECT category, count(*) AS n, avg(CASE WHEN calories > 0 THEN calories END) AS m, stddev_pop(CASE WHEN calories > 0 THEN calories END) AS sd FROM wide WHERE calories IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
 SELECT item_id, category, calories FROM wide JOIN s USING (category) WHERE calories > 0 AND abs(calories - m) > 3 * sd""")
def sigma_outliers(cat):
    return aggregates.sigma_outliers(cat.wide).select("item_id", "category", "calories")


QUARTILES = """, d AS (SELECT category, calories, item_id, row_number() OVER (PARTITION BY category ORDER BY calories DESC) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM wide WHERE calories <> 0),
 q AS (SELECT category, n, max(calories) FILTER (i = floor(n * 0.75)) AS q1, max(calories) FILTER (i = floor(n * 0.5)) AS median, max(calories) FILTER (i = floor(n * 0.25)) AS q3 FROM d GROUP BY ALL HAVING n >= 5)"""


@query("index_quartiles", QUARTILES + "SELECT category, n, q1, median, q3 FROM q")
def index_quartiles(cat):
    return aggregates.index_quartiles(cat.wide)


@query("quartile_outliers", QUARTILES + """SELECT item_id, category, calories FROM wide JOIN q USING (category) WHERE calories <> 0 AND calories < 10 AND category <> 'beverage' AND (calories > q3 + 2 * (q3 - q1) OR calories < q1 - 2 * (q3 - q1))""")
def quartile_outliers(cat):
    return aggregates.quartile_outliers(cat.wide).select("item_id", "category", "calories")


@query("ranking_violations", r""", t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY calories DESC, item_id) AS rank FROM wide WHERE calories IS NOT NULL)
 SELECT item_id, rank, 'HIGH' AS severity FROM t WHERE category = 'beverage' AND rank <= 20 AND calories > 100 AND regexp_matches(lower(name), '^(water|unsweetened.*tea|hot tea|brewed coffee|black coffee)')
 UNION ALL SELECT item_id, rank, 'MEDIUM' FROM t WHERE category = 'entree' AND rank <= 30 AND calories > 1000 AND regexp_matches(lower(name), '\bsalad\b') AND NOT regexp_matches(lower(name), 'loaded|crispy|fried|taco')""")
def ranking_violations(cat):
    return aggregates.ranking_violations(cat.wide).select("item_id", F.col("rank").cast("bigint").alias("rank"), "severity")


@query("alcohol_histogram", """SELECT CASE WHEN alcohol_grams >= 50 THEN 50 WHEN alcohol_grams >= 30 THEN 30 WHEN alcohol_grams >= 25 THEN 25 WHEN alcohol_grams >= 20 THEN 20 WHEN alcohol_grams >= 15 THEN 15
 WHEN alcohol_grams >= 12 THEN 12 WHEN alcohol_grams >= 8 THEN 8 WHEN alcohol_grams >= 1 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM nutrition WHERE alcohol_grams >= 0 GROUP BY 1""")
def alcohol_histogram(cat):
    return aggregates.histogram(cat.nutrition, "alcohol_grams")
