"""Imports, menu sources and soft validation over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.operators import imports, validate
from trencher.plans.matching import MATCH
from trencher.plans.registry import query
from trencher.sources import menus

# --- import: items under names of their own and of others ---------------------------

ROWS = {
    "row_id": "item_id",
    "park": "CASE item_id % 13 WHEN 0 THEN 'Atlantis Bay' WHEN 1 THEN 'atlantis' WHEN 2 THEN 'New Harbor' WHEN 3 THEN NULL WHEN 4 THEN upper(park_name) WHEN 5 THEN substr(park_name, 1, 6) ELSE park_name END",
    "restaurant": "CASE item_id % 7 WHEN 0 THEN 'Pop-Up Stand' WHEN 1 THEN upper(restaurant_name) ELSE restaurant_name END",
    "name": "CASE item_id % 5 WHEN 0 THEN concat(name, ' New') WHEN 1 THEN concat(upper(name), '!') WHEN 2 THEN 'Daily Special' ELSE name END",
    "land": "land",
    "description": "description",
}
ROWS_SQL = ", rows AS (SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in ROWS.items()) + " FROM wide)"


def _rows(wide):
    return wide.selectExpr(*[f"{sql} AS {c}" for c, sql in ROWS.items()])


LEVELS = """,
r AS (SELECT a.*, old.park_id, known.restaurant_id, known.restaurant_id IS NULL AS new_restaurant_id FROM (SELECT * FROM whole) AS a JOIN of_park AS old ON old.park = a.park
  LEFT JOIN (SELECT park_id, {name} AS restaurant_key, min(restaurant_id) AS restaurant_id FROM restaurants GROUP BY ALL) AS known ON known.park_id = old.park_id AND known.restaurant_key = a.restaurant_key),
i AS (SELECT r.*, known.item_id FROM r LEFT JOIN (SELECT restaurant_id, {dish} AS name_key, min(item_id) AS item_id FROM wide GROUP BY ALL) AS known ON known.restaurant_id = r.restaurant_id AND known.name_key = r.name_key),
v AS (SELECT *, CASE WHEN item_id IS NULL AND row_id = min(row_id) OVER (PARTITION BY park_group, restaurant_key, name_key) THEN 'imported' ELSE 'duplicate' END AS verdict FROM (SELECT i.*, of_park.park_group, of_park.new_park_id FROM i JOIN of_park USING (park)))
SELECT row_id, park_id, CASE WHEN new_restaurant_id THEN NULL ELSE restaurant_id END AS restaurant_id, item_id, new_park_id, new_restaurant_id, verdict FROM v
UNION ALL SELECT row_id, NULL, NULL, NULL, NULL, NULL, 'incomplete' FROM rows WHERE park IS NULL OR restaurant IS NULL OR name IS NULL"""


def _known_ids(found):
    """New ids are hashes of Spark's own; the checking SQL sees that they are new."""
    keep = lambda c, new: F.when(~new, F.col(c)).alias(c)
    return found.select("row_id", keep("park_id", F.col("new_park_id")), keep("restaurant_id", F.col("new_restaurant_id")),
                        F.when(F.col("known_item"), F.col("item_id")).alias("item_id"), "new_park_id", "new_restaurant_id", "verdict")


def _imported(cat, loose: bool):
    wide = cat.wide_of("item_id", "restaurant_id", "name", "restaurant_name", "park_name", "land", "description")
    items = wide.select("item_id", "restaurant_id", "name")
    found = imports.import_menus(_rows(wide), cat.parks, cat.restaurants, items, loose=loose)
    there = items.select("item_id").withColumn("there", F.lit(True))
    return _known_ids(found.join(there, "item_id", "left").withColumn("known_item", F.coalesce("there", F.lit(False))))


@query("exact_imports", ROWS_SQL + """, whole AS (SELECT *, restaurant AS restaurant_key, name AS name_key FROM rows WHERE park IS NOT NULL AND restaurant IS NOT NULL AND name IS NOT NULL),
of_park AS (SELECT park, min(park_id) AS park_id, min(park_id) IS NULL AS new_park_id, coalesce(CAST(min(park_id) AS VARCHAR), park) AS park_group FROM (SELECT DISTINCT park FROM whole) LEFT JOIN parks ON park_name = park GROUP BY park)"""
       + LEVELS.format(name="restaurant_name", dish="name"))
def exact_imports(cat):
    return _imported(cat, loose=False)


@query("loose_imports", ROWS_SQL + f""", whole AS (SELECT *, lower(restaurant) AS restaurant_key, {MATCH.format('name')} AS name_key FROM rows WHERE park IS NOT NULL AND restaurant IS NOT NULL AND name IS NOT NULL),
asked AS (SELECT lower(park) AS park_key, min(row_id) AS first FROM whole GROUP BY 1),
held AS (SELECT park_key, first, (SELECT min(park_id) FROM parks WHERE contains(lower(park_name), park_key)) AS park_id FROM asked),
made AS (SELECT a.park_key, arg_min(b.park_key, b.first) AS made_as FROM held a JOIN held b ON contains(b.park_key, a.park_key) WHERE a.park_id IS NULL AND b.park_id IS NULL GROUP BY a.park_key),
of_park AS (SELECT DISTINCT w.park, held.park_id, held.park_id IS NULL AS new_park_id, coalesce(CAST(held.park_id AS VARCHAR), made_as) AS park_group FROM whole w JOIN held ON held.park_key = lower(w.park) LEFT JOIN made ON made.park_key = held.park_key)"""
       + LEVELS.format(name="lower(restaurant_name)", dish=MATCH.format("name")))
def loose_imports(cat):
    return _imported(cat, loose=True)


# --- soft validation -----------------------------------------------------------------

DRINK = " OR ".join(f"regexp_matches(lower(coalesce(name, '')), '{p}')" for p in (
    r"\b(beer|ale|lager|stout|ipa|pilsner|porter)\b", r"\b(wine|sangria|mimosa|champagne|prosecco|bellini)\b",
    r"\b(cocktail|margarita|martini|daiquiri|mojito|paloma|mule|spritz|sour|old fashioned|negroni)\b", r"\b(bourbon|whiskey|vodka|rum|tequila|gin|sake|soju|mead|cider)\b"))
DISH = " OR ".join(f"regexp_matches(lower(coalesce(name, '')), '{p}')" for p in validate.DISHES)


@query("soft_validations", f""", r AS (SELECT nutrition_id, n.item_id, name, calories, protein * 4 + carbs * 4 + fat * 9 AS estimate FROM nutrition n LEFT JOIN items USING (item_id) WHERE calories <> 0),
d AS (SELECT *, abs(calories - estimate)::DOUBLE / nullif(greatest(estimate, 0), 0) AS deviation, ({DRINK}) AND NOT ({DISH}) AS drink FROM r)
SELECT nutrition_id, item_id, 'atwater_deviation' AS check_name, CASE WHEN deviation > 0.5::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(calories AS BIGINT) AS stated,
  CAST(estimate AS BIGINT) AS estimate, CAST(floor(deviation * 100 + 0.5::DOUBLE) AS BIGINT) AS deviation_pct FROM d WHERE NOT drink AND deviation > 0.3::DOUBLE
UNION ALL SELECT nutrition_id, item_id, 'extreme_calories', 'MEDIUM', CAST(calories AS BIGINT), NULL, NULL FROM d WHERE calories > 3000""")
def soft_validations(cat):
    return validate.soft_findings(cat.nutrition, cat.items)


# --- menus in payloads and pages: an order's lines are a menu --------------------------

#: The names as a source writes them: a note among them, and a second line of the same dish.
SHOWN = "CASE WHEN line = 3 AND order_id % 5 = 0 THEN 'Allergen Note: ask us' WHEN line = 2 AND order_id % 7 = 0 THEN upper(name) ELSE name END"
PRICED = "CASE WHEN order_id % 3 = 0 THEN NULL WHEN order_id % 11 = 0 THEN 'market price' ELSE concat('$ ', CAST(price AS VARCHAR(12)), ' each') END"
LINES = ("order_id", "line", "item_id")


def _menus(cat):
    return cat.nutrition.select(*LINES).join(cat.items.select("item_id", "name", "description", "price"), "item_id").selectExpr(
        *LINES, f"{SHOWN} AS shown", "concat(description, ' <i>&amp; more</i>') AS told", f"{PRICED} AS priced")


def _payloads(cat):
    """An order is a payload in the newer layout, the older one, or torn off; its lines are few."""
    value = lambda c: F.struct(F.array(F.col(c)).alias("Values"))
    inner = lambda x: F.struct(x.alias("EmbeddedValues"))
    line = F.struct("line", "item_id", value("shown").alias("name"), value("told").alias("told"), value("priced").alias("priced"))
    grouped = _menus(cat).groupBy("order_id").agg(F.array_sort(F.collect_list(line)).alias("dishes"))
    new = F.transform("dishes", lambda d: F.struct(d["name"].alias("heading"), d["told"].alias("description")))
    old = F.transform("dishes", lambda d: F.struct(d["name"].alias("Title"), d["told"].alias("ShortDescription"), d["priced"].alias("Price")))
    newer = F.to_json(F.struct(F.struct(inner(F.array(F.struct(inner(new).alias("items")))).alias("sections")).alias("page")))
    menu = F.struct(inner(F.array(F.struct(inner(old).alias("DishDetails")))).alias("MenuDetails"))
    older = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(F.lit(menus.OLD_SCHEMA).alias("Title")).alias("Schema"), menu.alias("Fields")).alias("Component"))).alias("ComponentPresentations")))
    content = F.when(F.col("order_id") % 3 == 0, newer).when(F.col("order_id") % 19 == 0, F.substring(older, 1, 60)).otherwise(older)
    return grouped.select(F.col("order_id").alias("payload_id"), content.alias("content"))


def _category(name: str) -> str:
    rule = lambda words, then: rf"WHEN regexp_matches(lower({name}), '\b({words})\b') THEN '{then}'"
    return ("CASE " + rule("drink|soda|lemonade|tea|coffee|smoothie|shake|beer|wine|cocktail|margarita|juice|water|milk", "beverage")
            + rf" WHEN regexp_matches(lower({name}), '\b(cookie|cake|brownie|sundae|ice cream|gelato|mousse|pudding|churro|funnel|waffle|donut|cupcake|pie|tart|cobbler|crisp)\b') AND NOT contains(lower({name}), 'crispy') THEN 'dessert' "
            + rule("fries|coleslaw|corn|rice|beans|side salad|fruit cup|tots|onion rings", "side") + " "
            + rule("snack|popcorn|churro|pretzel|corn dog|turkey leg|wings|nachos|dip", "snack") + " END")


LINES_SQL = f""", m AS (SELECT order_id, line, n.item_id, {SHOWN} AS shown, description || ' <i>&amp; more</i>' AS told, {PRICED} AS priced FROM nutrition n JOIN items USING (item_id))"""
#: Tags out and the one entity read; a missing cell stays missing.
PLAIN = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&amp;', '&', 'gi'))"


@query("payload_menus", LINES_SQL + f""", u AS (SELECT * FROM m WHERE NOT contains(lower(shown), 'allergen note') QUALIFY row_number() OVER (PARTITION BY order_id, lower(shown) ORDER BY line, item_id) = 1)
SELECT order_id AS payload_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, item_id) AS INT) AS "at", shown AS name,
  CASE WHEN order_id % 3 = 0 THEN told ELSE {PLAIN.format('told')} END AS description,
  CASE WHEN order_id % 3 <> 0 THEN try_cast(regexp_replace(priced, '[^0-9.]', '', 'g') AS DOUBLE) END AS price, {_category('shown')} AS category
FROM u WHERE order_id % 3 = 0 OR order_id % 19 <> 0""")
def payload_menus(cat):
    return menus.menu_payloads(_payloads(cat))


@query("page_lists", r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1)) AS li, generate_subscripts(regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1), 1) AS n FROM pages),
t AS (SELECT page_id, n, regexp_replace(html_unescaped, '^[\s ]+|[\s ]+$', '', 'g') AS text FROM (SELECT page_id, n, replace(replace(replace(replace(replace(regexp_replace(li, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS html_unescaped FROM p)),
d AS (SELECT page_id, n, CASE WHEN regexp_matches(text, '(?s)^(.+?)\s*[-–]\s*\$?([\d.]+)$') THEN trim(regexp_extract(text, '(?s)^(.+?)\s*[-–]\s*\$?([\d.]+)$', 1)) ELSE text END AS name,
  try_cast(regexp_extract(text, '(?s)^(.+?)\s*[-–]\s*\$?([\d.]+)$', 2) AS DOUBLE) AS price FROM t)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INT) AS "at", name, NULL AS description, price, """ + _category("name") + """ AS category FROM d WHERE length(name) >= 3""", base=False)
def page_lists(cat):
    return menus.menu_pages(cat.table("pages"))


@query("page_tables", LINES_SQL + f""", t AS (SELECT order_id, line, item_id, {PLAIN.format('shown')} AS shown, {PLAIN.format('told')} AS told, priced FROM m)
SELECT order_id AS page_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line, item_id) AS INT) AS "at", shown AS name, told AS description,
  try_cast(regexp_extract(coalesce(priced, ''), '([0-9.]+)', 1) AS DOUBLE) AS price, {_category('shown')} AS category FROM t WHERE length(shown) >= 3""")
def page_tables(cat):
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c), F.lit("")), F.lit("</td>"))
    rows = _menus(cat).select("order_id", F.struct("line", "item_id", F.concat(F.lit("<TR class='dish'>"), cell("shown"), cell("told"), cell("priced"), F.lit("</TR>\n")).alias("row")).alias("x"))
    pages = rows.groupBy("order_id").agg(F.array_sort(F.collect_list("x")).alias("rows")).select(
        F.col("order_id").alias("page_id"), F.concat(F.lit("<html><table>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table><ul><li>no dish</li></ul></html>")).alias("html"))
    return menus.menu_pages(pages)
