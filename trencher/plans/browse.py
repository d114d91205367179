"""Browse-side queries: text, score, filters, sorts, dedupe, hierarchy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trencher.functions import detect, scoring, text
from trencher.functions.numeric import net_carbs
from trencher.operators import assemble, browse
from trencher.plans.registry import query

# --- shared SQL pieces -------------------------------------------------------

DISPLAY = r"""trim(regexp_replace(CASE WHEN regexp_matches(x2, '^\d+\.\s+[A-Z][A-Z\s-]+$') THEN regexp_replace(x2, '^\d+\.\s+', '') ELSE x2 END, '\s+', ' ', 'g'))"""
DISPLAYED = rf""", shown AS (SELECT * EXCLUDE (x1, x2), {DISPLAY} AS cleaned,
  CASE WHEN {DISPLAY} = '' THEN name ELSE {DISPLAY} END AS display_name FROM (
  SELECT *, regexp_replace(x1, '^[\s\-_*?.,:;|/\\]+', '') AS x2 FROM (
  SELECT *, replace(regexp_replace(name, '<[^>]*>', '', 'g'), '&amp;', '&') AS x1 FROM wide)))"""
SCORED = DISPLAYED + f""", ratios AS (SELECT *, greatest(0, carbs - coalesce(fiber, 0)) AS net,
  coalesce(sugar, 0)::DOUBLE / nullif(carbs, 0) AS sr, coalesce(protein, 0)::DOUBLE / nullif(carbs, 0) AS pr FROM shown),
points AS (SELECT *,
  CASE WHEN net <= 15 THEN 100 WHEN net <= 30 THEN 80 WHEN net <= 45 THEN 60 WHEN net <= 60 THEN 40 WHEN net <= 80 THEN 20 ELSE 0 END AS p1,
  CASE WHEN carbs = 0 THEN 100 WHEN sr < 0.2::DOUBLE THEN 100 WHEN sr < 0.4::DOUBLE THEN 70 WHEN sr < 0.6::DOUBLE THEN 40 ELSE 10 END AS p2,
  CASE WHEN carbs = 0 THEN 100 WHEN pr > 1 THEN 100 WHEN pr > 0.5::DOUBLE THEN 75 WHEN pr > 0.25::DOUBLE THEN 50 ELSE 20 END AS p3,
  CASE WHEN coalesce(fiber, 0) >= 8 THEN 100 WHEN coalesce(fiber, 0) >= 5 THEN 75 WHEN coalesce(fiber, 0) >= 2 THEN 50 ELSE 20 END AS p4,
  CASE WHEN calories < 300 THEN 100 WHEN calories < 500 THEN 75 WHEN calories < 700 THEN 50 ELSE 25 END AS p5 FROM ratios),
scored AS (SELECT * EXCLUDE (net, sr, pr, p1, p2, p3, p4, p5, s), s AS score,
  CASE WHEN s IS NULL THEN NULL WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN category = 'beverage' OR regexp_matches(lower(display_name), '{detect.MERCHANDISE}') THEN category
       WHEN (coalesce(alcohol_grams, 0) > 0 OR regexp_matches(lower(display_name), '{detect.DRINK_WORDS}'))
            AND NOT regexp_matches(lower(display_name), '{detect.FOOD_CONTEXT}') THEN 'beverage' ELSE category END AS display_category,
  CASE WHEN cleaned = '' THEN true WHEN regexp_matches(cleaned, '^\\d+%') THEN false
       WHEN regexp_matches(cleaned, '^\\d+\\s+[A-Za-z]') AND NOT regexp_matches(name, '^\\d+\\.\\s+') THEN false
       ELSE regexp_matches(lower(cleaned), '{detect.HEADER_WORDS}') END AS is_header
  FROM (SELECT *, CASE WHEN calories IS NULL OR carbs IS NULL THEN NULL WHEN calories = 0 AND carbs = 0 THEN 100
  ELSE greatest(0, CAST(floor(p1 * 0.4::DOUBLE + p2 * 0.2::DOUBLE + p3 * 0.15::DOUBLE + p4 * 0.15::DOUBLE + p5 * 0.1::DOUBLE
  - (CASE WHEN coalesce(alcohol_grams, 0) > 0 THEN 15 ELSE 0 END) + 0.5::DOUBLE) AS INT)) END AS s FROM points))
""".replace("\\\\d", "\\d").replace("\\\\s", "\\s").replace("\\\\.", "\\.")


# --- scores, bands, annotations, trust -----------------------------------------

@query("item_scores", SCORED + "SELECT item_id, score, grade FROM scored")
def item_scores(cat):
    return browse.with_display(cat.wide).select("item_id", "score", "grade")


@query("net_carbs_and_bands", """SELECT item_id, greatest(0, carbs - coalesce(fiber, 0)) AS net_carbs,
  CASE WHEN carbs <= 30 THEN 'green' WHEN carbs <= 60 THEN 'amber' WHEN carbs > 60 THEN 'rose' END AS carbs_band,
  CASE WHEN sugar < 10 THEN 'green' WHEN sugar <= 25 THEN 'amber' WHEN sugar > 25 THEN 'rose' END AS sugar_band,
  CASE WHEN calories < 400 THEN 'green' WHEN calories <= 700 THEN 'amber' WHEN calories > 700 THEN 'rose' END AS calories_band,
  CASE WHEN sodium < 500 THEN 'green' WHEN sodium <= 1000 THEN 'amber' WHEN sodium > 1000 THEN 'rose' END AS sodium_band,
  CASE WHEN alcohol_grams <= 14 THEN 'purple' WHEN alcohol_grams <= 28 THEN 'amber' WHEN alcohol_grams > 28 THEN 'rose' END AS alcohol_band,
  CASE WHEN protein >= 20 THEN 'green' WHEN protein >= 10 THEN 'amber' WHEN protein < 10 THEN 'rose' END AS protein_band
  FROM wide WHERE carbs IS NOT NULL""")
def net_carbs_and_bands(cat):
    df = cat.wide.where("carbs IS NOT NULL")
    return df.select("item_id", net_carbs(F.col("carbs"), F.col("fiber")).alias("net_carbs"),
                     *(c.alias(n) for n, c in scoring.severity_bands().items()))


@query("dietary_annotations", r""", n AS (SELECT item_id, calories, carbs, category, is_fried, coalesce(sugar,0) s, coalesce(fiber,0) f,
  coalesce(protein,0) p, coalesce(fat,0) fa, coalesce(alcohol_grams,0) a FROM wide WHERE calories IS NOT NULL AND carbs IS NOT NULL),
r AS (SELECT *, CASE WHEN carbs > 0 THEN s::DOUBLE / carbs ELSE 0 END sr,
  CASE WHEN carbs > 0 THEN p::DOUBLE / carbs WHEN p > 0 THEN 10 ELSE 0 END pr FROM n),
long AS (
  SELECT item_id, 0 o, 'Zero carb — no glucose impact' t, 'green' v FROM r WHERE carbs = 0 AND category = 'beverage'
  UNION ALL SELECT item_id, 1, 'Liquid sugar — fastest possible glucose spike', 'red' FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND category = 'beverage' AND s > 25
  UNION ALL SELECT item_id, 2, CASE WHEN carbs > 30 THEN 'High carbs + alcohol — initial spike then delayed drop. Complex dosing.' ELSE 'Contains alcohol — may cause delayed hypoglycemia. Monitor BG for 12+ hours' END, 'red' FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND a > 0
  UNION ALL SELECT item_id, 3, CASE WHEN sr > 0.6::DOUBLE AND category <> 'beverage' THEN 'High simple sugar — expect rapid glucose spike' ELSE 'Moderate sugar with high carbs — bolus early' END,
    CASE WHEN sr > 0.6::DOUBLE AND category <> 'beverage' THEN 'red' ELSE 'amber' END FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND ((sr > 0.6::DOUBLE AND category <> 'beverage') OR (sr > 0.4::DOUBLE AND carbs > 40))
  UNION ALL SELECT item_id, 4, 'High fat may delay carb absorption — consider extended bolus', 'amber' FROM r WHERE fa > 40 AND carbs > 40
  UNION ALL SELECT item_id, 5, 'Fried + high carb — fat delays peak but doesn''t reduce it', 'amber' FROM r WHERE is_fried AND carbs > 40 AND fa <= 40
  UNION ALL SELECT item_id, 6, 'Strong protein — may blunt postprandial rise', 'green' FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND pr > 0.8::DOUBLE
  UNION ALL SELECT item_id, 7, CASE WHEN carbs > 50 THEN 'High fiber offsets some carb impact — watch net carbs' ELSE 'Good fiber content — slower carb absorption' END, CASE WHEN carbs > 50 THEN 'teal' ELSE 'green' END FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND f > 6),
minimal AS (SELECT item_id, 8, 'Minimal glucose impact — may not need bolus', 'green' FROM r WHERE NOT (carbs = 0 AND category = 'beverage') AND carbs < 15 AND calories < 200
  AND item_id NOT IN (SELECT item_id FROM long WHERE v IN ('red', 'amber')))
SELECT item_id, string_agg(v || ': ' || t, ' | ' ORDER BY o) AS notes, count(*) AS n_notes FROM (SELECT * FROM long UNION ALL SELECT * FROM minimal) GROUP BY item_id""")
def dietary_annotations(cat):
    df = cat.wide.select("item_id", scoring.annotations().alias("a")).where("size(a) > 0")
    return df.select(
        "item_id",
        F.array_join(F.transform("a", lambda n: F.concat(n["severity"], F.lit(": "), n["text"])), " | ").alias("notes"),
        F.size("a").cast("bigint").alias("n_notes"),
    )


@query("nutrition_trust", """, w AS (SELECT *, concat_ws(' ', CASE WHEN coalesce(protein,0) >= 120 THEN 'Protein looks unusually high for a single menu item.' END,
    CASE WHEN coalesce(calories,0) >= 2000 THEN 'Calories look unusually high for a single menu item.' END,
    CASE WHEN coalesce(sodium,0) >= 3000 THEN 'Sodium looks unusually high for a single menu item.' END,
    CASE WHEN confidence_score < 70 AND carbs = 0 AND coalesce(calories,0) >= 300 THEN 'Zero-carb estimate is low-confidence for a substantial item.' END) AS warnings FROM wide)
SELECT item_id, warnings,
  CASE WHEN nutrition_id IS NULL THEN 'unavailable' WHEN confidence_score < 70 THEN 'low' WHEN source = 'official' THEN 'verified' ELSE 'estimated' END AS trust_level,
  CASE WHEN nutrition_id IS NULL THEN 'Nutrition unavailable' WHEN confidence_score < 70 THEN 'Low-confidence estimate' WHEN source = 'official' THEN 'Official nutrition' ELSE 'Estimated nutrition' END AS trust_label,
  CASE WHEN nutrition_id IS NULL THEN 'No source' WHEN source = 'official' THEN 'Official' WHEN source = 'api_lookup' THEN 'API lookup' ELSE 'Crowdsourced' END AS source_label,
  CASE WHEN nutrition_id IS NOT NULL THEN confidence_score || '% confidence' END AS confidence_label,
  CASE WHEN nutrition_created_at IS NOT NULL THEN 'Last updated ' || strftime(nutrition_created_at, '%b %-d, %Y') END AS last_updated_label,
  CASE WHEN nutrition_id IS NULL THEN 'This item should not be treated as zero-carb or zero-calorie.'
       WHEN confidence_score < 70 THEN 'Do not dose from this value without verifying it.'
       WHEN source = 'official' THEN CASE WHEN warnings <> '' THEN 'Some values look unusual for a single serving. Verify serving size before using them.' END
       WHEN warnings <> '' THEN 'Some estimated values look unusual. Verify carbs and serving size before dosing.' ELSE 'Verify carbs before dosing.' END AS caution
  FROM w""")
def nutrition_trust(cat):
    return cat.wide.select(
        "item_id", scoring.trust_level().alias("trust_level"),
        F.array_join(scoring.quality_warnings(), " ").alias("warnings"),
        *(c.alias(n) for n, c in scoring.trust_labels().items()),
    )


@query("usable_nutrition", DISPLAYED + r"""SELECT item_id, (nutrition_id IS NOT NULL AND (calories IS NOT NULL OR carbs IS NOT NULL)
  AND (greatest(abs(coalesce(calories,0)), abs(coalesce(carbs,0)), abs(coalesce(fat,0)), abs(coalesce(sugar,0)), abs(coalesce(protein,0)), abs(coalesce(fiber,0)), abs(coalesce(sodium,0)), abs(coalesce(cholesterol,0)), abs(coalesce(alcohol_grams,0))) > 0
   OR (source = 'official' AND confidence_score >= 70) OR regexp_matches(lower(display_name), '\b(water|unsweetened tea|black coffee|diet soda|diet coke|diet pepsi)\b'))) AS usable FROM shown""")
def usable_nutrition(cat):
    return cat.wide.select("item_id", scoring.usable_nutrition().alias("usable"))


# --- text ------------------------------------------------------------------------

@query("display_names", SCORED + "SELECT item_id, display_name, is_header, display_category FROM scored")
def display_names(cat):
    return cat.wide.select(
        "item_id", text.display_name(F.col("name")).alias("display_name"),
        detect.section_header(F.col("name")).alias("is_header"), detect.display_category().alias("display_category"),
    )


@query("name_keys", DISPLAYED + r"""SELECT item_id,
  trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS match_key,
  trim(regexp_replace(replace(lower(name), '''', ''), '[^a-z0-9]+', ' ', 'g')) AS spaced_key,
  trim(regexp_replace(lower(cleaned), '[^a-z0-9]+', ' ', 'g')) AS canonical_key,
  trim(regexp_replace(regexp_replace(lower(name), '\s*-\s*', ' ', 'g'), '\s+', ' ', 'g')) AS chain_key,
  CASE WHEN regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') = '' THEN 'unknown' ELSE regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') END AS slug,
  regexp_replace(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_slug
  FROM shown""")
def name_keys(cat):
    n = F.col("name")
    return cat.wide.select(
        "item_id", text.match_name(n).alias("match_key"), text.spaced_name(n).alias("spaced_key"),
        text.canonical_key(n).alias("canonical_key"), text.chain_name(n).alias("chain_key"),
        text.slug(n).alias("slug"), text.file_slug(n).alias("file_slug"),
    )


# --- filters, sorts, paging --------------------------------------------------------

FILTERED = "item_id, display_name, display_category, carbs, calories, score, grade, restaurant_name"


@query("browse_view", SCORED + """, ranked AS (SELECT * FROM scored WHERE NOT is_header AND carbs <= 60 AND NOT is_fried AND display_category <> 'beverage' AND grade IN ('A', 'B', 'C')
   AND item_id NOT IN (SELECT item_id FROM allergens WHERE lower(allergen_type) = 'wheat'))
SELECT item_id, display_name, display_category, carbs, calories, score, grade, restaurant_name FROM ranked ORDER BY score DESC NULLS LAST, item_id LIMIT 48""")
def browse_view(cat):
    spec = browse.FilterSpec(max_carbs=60, hide_fried=True, hide_drinks=True, grades=("A", "B", "C"), allergen_free=("WHEAT",), sort="grade")
    df = browse.apply_filters(cat.wide, cat.allergens, spec)
    return browse.page(df.orderBy(*browse.sort_keys(spec.sort))).select(*FILTERED.split(", "))


@query("browse_presets", SCORED + f""", ok AS (SELECT * FROM scored WHERE NOT is_header)
SELECT 'low-carb' AS preset, {FILTERED} FROM ok WHERE carbs <= 30
UNION ALL SELECT 'top-rated', {FILTERED} FROM ok WHERE grade IN ('A', 'B')
UNION ALL SELECT 'gluten-free', {FILTERED} FROM ok WHERE NOT EXISTS (SELECT 1 FROM allergens a WHERE a.item_id = ok.item_id AND lower(allergen_type) = 'wheat')
UNION ALL SELECT 'vegetarian', {FILTERED} FROM ok WHERE is_vegetarian
UNION ALL SELECT 'no-fried', {FILTERED} FROM ok WHERE NOT is_fried""")
def browse_presets(cat):
    out = None
    for name, spec in browse.PRESETS.items():
        part = browse.apply_filters(cat.wide, cat.allergens, spec).select(F.lit(name).alias("preset"), *FILTERED.split(", "))
        out = part if out is None else out.unionByName(part)
    return out


@query("browse_search_filter", SCORED + f"""SELECT {FILTERED} FROM scored WHERE NOT is_header AND (alcohol_grams IS NULL OR alcohol_grams = 0)
  AND (contains(lower(display_name), 'chicken') OR contains(lower(description), 'chicken') OR contains(lower(restaurant_name), 'chicken'))""")
def browse_search_filter(cat):
    spec = browse.FilterSpec(search="  Chicken ", hide_alcohol=True)
    return browse.apply_filters(cat.wide, cat.allergens, spec).select(*FILTERED.split(", "))


@query("browse_category_filter", SCORED + f"SELECT {FILTERED} FROM scored WHERE NOT is_header AND display_category = 'beverage'")
def browse_category_filter(cat):
    return browse.apply_filters(cat.wide, cat.allergens, browse.FilterSpec(category="beverage")).select(*FILTERED.split(", "))


@query("sort_modes", SCORED + " UNION ALL ".join(
    f"(SELECT '{n}' AS mode, item_id, position FROM (SELECT item_id, row_number() OVER (ORDER BY {o}, item_id) AS position FROM scored) WHERE position <= 48)"
    for n, o in (("carbsAsc", "carbs ASC NULLS LAST"), ("carbsDesc", "carbs DESC NULLS LAST"), ("caloriesAsc", "calories ASC NULLS LAST"),
                 ("caloriesDesc", "calories DESC NULLS LAST"), ("grade", "score DESC NULLS LAST"),
                 ("favourite-carbsAsc", "coalesce(carbs, 999)"), ("favourite-carbsDesc", "coalesce(carbs, 0) DESC"), ("favourite-grade", "coalesce(score, -1) DESC"))))
def sort_modes(cat):
    """Every numeric sort; one page of each with its position."""
    shown = browse.with_display(cat.wide)
    keys = {m: browse.sort_keys(m) for m in browse.SORTS if m != "name"}
    keys |= {f"favourite-{m}": browse.favourite_keys(m) for m in ("carbsAsc", "carbsDesc", "grade")}
    out = None
    for mode, order in keys.items():
        first = browse.page(shown.orderBy(*order))
        part = first.select(F.lit(mode).alias("mode"), "item_id", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


@query("seasonal_items", "SELECT item_id, name FROM wide WHERE is_seasonal")
def seasonal_items(cat):
    return browse.seasonal_only(cat.wide).select("item_id", "name")


@query("top_picks", SCORED + "SELECT item_id, score, grade FROM scored WHERE grade IN ('A', 'B') ORDER BY score DESC, item_id LIMIT 10")
def top_picks(cat):
    return browse.top_picks(cat.wide).select("item_id", "score", "grade")


@query("browse_summary", SCORED + """, f AS (SELECT * FROM scored WHERE NOT is_header AND carbs <= 30)
SELECT (SELECT count(*) FROM f) AS filtered_count, (SELECT count(DISTINCT restaurant_id) FROM f) AS restaurant_count,
 (SELECT count(*) FROM wide WHERE park_id IS NOT NULL) AS loaded_count, (SELECT count(*) FROM items) AS total_count,
 least(48, (SELECT count(*) FROM f)) AS visible_count, (SELECT count(*) FROM items) > (SELECT count(*) FROM wide WHERE park_id IS NOT NULL) AS is_preview,
 (SELECT count(*) FROM f) > 48 AS has_more""")
def browse_summary(cat):
    spec = browse.PRESETS["low-carb"]
    return browse.browse_summary(
        browse.apply_filters(cat.wide, cat.allergens, spec), cat.wide.where("park_id IS NOT NULL"), cat.items, browse.PAGE
    )


@query("compare_best", """, m AS (SELECT restaurant_id, item_id, unnest(['carbs','net_carbs','sugar','fiber','calories','protein','fat','sodium']) AS metric,
  unnest([carbs::DOUBLE, greatest(0, carbs - fiber)::DOUBLE, sugar::DOUBLE, fiber::DOUBLE, calories::DOUBLE, protein::DOUBLE, fat::DOUBLE, sodium::DOUBLE]) AS value FROM wide WHERE restaurant_id IS NOT NULL)
SELECT restaurant_id, metric, item_id AS best_item, value AS best_value FROM m WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY restaurant_id, metric ORDER BY CASE WHEN metric IN ('fiber', 'protein') THEN -value ELSE value END, item_id) = 1""")
def compare_best(cat):
    return browse.best_in_row(cat.wide.where("restaurant_id IS NOT NULL"), "restaurant_id", "item_id")


# --- assembly ------------------------------------------------------------------------

@query("wide_items", "SELECT item_id, name, restaurant_name, park_name, nutrition_id, calories, carbs, source FROM wide")
def wide(cat):
    return cat.wide.select("item_id", "name", "restaurant_name", "park_name", "nutrition_id", "calories", "carbs", "source")


@query("nested_items", """SELECT i.item_id, coalesce(n.c, 0) AS n_nutrition, coalesce(a.c, 0) AS n_allergens, n.hi AS max_calories
 FROM items i LEFT JOIN (SELECT item_id, count(*) c, max(calories) hi FROM nutrition GROUP BY 1) n USING (item_id)
 LEFT JOIN (SELECT item_id, count(*) c FROM allergens GROUP BY 1) a USING (item_id)""")
def nested_items(cat):
    docs = assemble.nested_items(cat.items, cat.nutrition, cat.allergens)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    return docs.select(
        "item_id", size("nutritional_data").alias("n_nutrition"), size("allergens").alias("n_allergens"),
        F.array_max(F.transform("nutritional_data", lambda n: n["calories"])).alias("max_calories"),
    )


@query("items_of_parks", """SELECT item_id, name FROM wide WHERE park_name IN ('EPCOT', 'Aulani')""")
def items_of_parks(cat):
    chosen = cat.parks.where(F.col("park_name").isin("EPCOT", "Aulani")).select("park_id")
    placed = cat.items.join(cat.wide.select("item_id", "restaurant_id"), "item_id")
    return assemble.restrict_to_parks(placed, cat.restaurants, chosen).select("item_id", "name")


@query("items_by_keys", """SELECT item_id, name FROM items WHERE item_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def items_by_keys(cat):
    ids = cat.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item_id"))
    return assemble.lookup_items(cat.items, ids).select("item_id", "name")


@query("pending_calories", """SELECT item_id, CASE WHEN nutrition_id IS NULL THEN 'no_record' ELSE 'null_calories' END AS reason FROM wide WHERE calories IS NULL""")
def pending_calories(cat):
    return assemble.pending_calories(cat.wide).select("item_id", "reason")
