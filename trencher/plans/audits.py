"""Queries over the data-quality suites."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.functions import detect
from trencher.functions.vocab import alcohol as A
from trencher.functions.vocab import drinks as D
from trencher.functions.vocab import foods
from trencher.operators import audit
from trencher.plans import looks
from trencher.plans.catalogue import quoted
from trencher.plans.registry import query

NAME = "lower(name)"


def rx(text: str, pattern: str) -> str:
    """Regex test in the checking SQL: what a look-ahead forbids is blanked out of the text instead."""
    for look, blank in ((r"(?!\s*chicken)", r"corona\s*chicken"), (r"(?!\s*stout)", r"milk\s*stout")):
        if look in pattern:
            pattern, text = pattern.replace(look, ""), f"regexp_replace({text}, '{blank}', '#', 'g')"
    return f"regexp_matches({text}, {quoted(pattern)})"


def pairs(text: str, table) -> str:
    return "(" + " OR ".join(rx(text, i) + (f" AND NOT {rx(text, x)}" if x else "") for i, x in table) + ")"


ALCOHOLIC = "coalesce((" + " OR ".join([
    rx(NAME, "|".join((A.DEFINITIVE_COCKTAIL, A.BRAND_BEER, A.BRAND_SELTZER_CIDER, A.AGE_RESTRICTED))),
    rx(NAME, r"\bcocktail\b") + " AND NOT " + rx(NAME, r"\b(shrimp|prawn|fruit|crab|seafood)\b"),
    rx(NAME, r"\bbrew\b") + " AND NOT " + rx(NAME, r"\bcold\s*brew\b"), rx(NAME, r"\bflight\b"),
    *(rx(NAME, p) for p in (A.BEER, A.WINE, A.COCKTAIL, A.SPIRIT, A.OTHER)),
    *(rx("lower(coalesce(description, ''))", p) for p in (A.SPIRIT, A.COCKTAIL, A.BEER, A.WINE, A.OTHER, A.BRAND_BEER, A.DEFINITIVE_COCKTAIL)),
    f"NOT {rx(NAME, A.NEGATIVE)} AND {rx('lower(restaurant_name)', A.BAR_PLACE)} AND NOT {rx(NAME, A.SOFT_DRINK)}",
]) + "), false)"
ATWATER = "(4 * protein + 4 * carbs + 9 * fat)"
ATWATER0 = "(4 * coalesce(protein, 0) + 4 * coalesce(carbs, 0) + 9 * coalesce(fat, 0))"
OVER = f"(CASE WHEN {ATWATER0} > 0 THEN coalesce(calories, 0)::DOUBLE / {ATWATER0} ELSE 0 END)"
PLACE = "lower(coalesce(restaurant_name, ''))"
GAP_AWARE = "(" + " OR ".join([
    pairs(NAME, D.GAP_AWARE), rx(NAME, r"\btop shelf\b") + " AND " + rx(PLACE, D.TOP_SHELF_PLACE),
    f"{rx(NAME, D.DRAFT_NAME)} AND NOT {rx(NAME, D.DRAFT_NOT)} AND (category = 'beverage' OR {rx(PLACE, D.DRAFT_PLACE)})",
    f"{rx(PLACE, D.BAR_LIKE)} AND (coalesce(fat, 0) < 5 OR contains({NAME}, 'punch') OR (contains({NAME}, 'flight') AND NOT contains({NAME}, 'chicken flight')))",
    "category = 'beverage' AND coalesce(fat, 0) <= 1 AND coalesce(protein, 0) <= 2 AND calories > 100",
    f"coalesce(fat, 0) = 0 AND calories > 100 AND ((coalesce(protein, 0) <= 2 AND {OVER} > 1.5) OR (coalesce(protein, 0) <= 15 AND {OVER} > 2.0))",
]) + ")"


def findings(rows: list[tuple[str, str, str]], source: str = "wide", extra: str = "") -> str:
    """UNION ALL of (check, severity SQL, condition) selects."""
    return " UNION ALL ".join(
        f"SELECT item_id, '{n}' AS check_name, {s if s.startswith('CASE') else quoted(s)} AS severity{extra} FROM {source} WHERE {c}" for n, s, c in rows
    )


def short(df):
    return df.select("item_id", "check_name", "severity")


# --- detectors ---------------------------------------------------------------------------

@query("alcohol_detectors", f"""SELECT item_id, {ALCOHOLIC} AS likely, {rx(NAME, A.TRIGGER_INCLUDE)} AND NOT {rx(NAME, A.TRIGGER_EXCLUDE)} AS by_trigger, {GAP_AWARE} AS gap_aware,
 {pairs(NAME, D.BEVERAGE_NAMES)} AS beverage_name, (category = 'beverage' OR {pairs(NAME, D.DISH_NOT_DRINK)}) AS dish_is_drink,
 (category = 'beverage' OR ({rx(NAME, D.SIMPLE_INCLUDE)} AND NOT {rx(NAME, D.SIMPLE_EXCLUDE)}) OR {rx(PLACE, D.SIMPLE_PLACE)}) AS simple_drink FROM wide""")
def alcohol_detectors(cat):
    return cat.wide.select(
        "item_id", detect.likely_alcoholic().alias("likely"), detect.trigger_alcoholic(F.col("name")).alias("by_trigger"),
        detect.gap_aware_alcoholic().alias("gap_aware"), detect.beverage_by_name(F.col("name")).alias("beverage_name"),
        detect.dish_is_drink().alias("dish_is_drink"), detect.simple_drink().alias("simple_drink"))


def _food_types_sql() -> str:
    """Step views that mirror the definition: plain labels by list, bare ones by what is already there."""
    steps, batch, n = [", ft0 AS (SELECT *, lower(concat_ws(' ', name, coalesce(description, ''))) AS ft, []::VARCHAR[] AS food_types FROM wide)"], [], 0

    def test(i, x):
        return rx("ft", i) + (f" AND NOT {rx('ft', x)}" if x else "")

    def flush():
        nonlocal n, batch
        if batch:
            steps.append(f"ft{n + 1} AS (SELECT * REPLACE (food_types || list_filter([{', '.join(batch)}], lambda t: t IS NOT NULL) AS food_types) FROM ft{n})")
            n, batch = n + 1, []

    for label, include, exclude, group in foods.FOOD_TYPES:
        if group == "bare":
            flush()
            steps.append(f"ft{n + 1} AS (SELECT * REPLACE (CASE WHEN len(food_types) = 0 AND {test(include, exclude)} THEN ['{label}'] ELSE food_types END AS food_types) FROM ft{n})")
            n += 1
        else:
            batch.append(f"CASE WHEN {test(include, exclude)} THEN '{label}' END")
    flush()
    steps.append(f"typed AS (SELECT * REPLACE (CASE WHEN len(food_types) = 0 THEN [category || '_generic'] ELSE food_types END AS food_types) FROM ft{n})")
    return ", ".join(steps)


TYPED = _food_types_sql()


@query("food_types", TYPED + "SELECT item_id, array_to_string(food_types, ',') AS food_types FROM typed")
def food_types(cat):
    return detect.with_food_types(cat.wide).select("item_id", F.array_join("food_types", ",").alias("food_types"))


def _first_sql(text: str, pairs_, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {rx(text, p)} THEN {quoted(v)}" for p, v in pairs_) + f" ELSE {quoted(otherwise)} END"


@query("park_attributes", f"""SELECT park_id, {_first_sql('lower(park_name)', detect.PARK_TYPES, 'other')} AS park_type, {_first_sql('lower(park_name)', detect.LOCATIONS, 'Other')} AS location,
 {_first_sql('lower(park_name)', detect.TIMEZONES, 'America/New_York')} AS timezone FROM parks""")
def park_attributes(cat):
    n = F.col("park_name")
    return cat.parks.select("park_id", detect.park_type(n).alias("park_type"), detect.park_location(n).alias("location"), detect.park_timezone(n).alias("timezone"))


@query("vegetarian_and_fried", f"""SELECT item_id, {rx("lower(concat_ws(' ', name, description))", detect.VEGETARIAN)} AS vegetarian, {rx("lower(concat_ws(' ', name, description))", detect.FRIED)} AS fried, {rx(NAME, detect.PLACEHOLDER)} AS placeholder FROM wide""")
def vegetarian_and_fried(cat):
    text = F.concat_ws(" ", "name", "description")
    return cat.wide.select("item_id", detect.infer_vegetarian(text).alias("vegetarian"), detect.infer_fried(text).alias("fried"), detect.placeholder(F.col("name")).alias("placeholder"))


# --- accuracy ------------------------------------------------------------------------------

BEVERAGE = f"(category = 'beverage' OR {rx(NAME, detect.COFFEE_AND_JUICE)})"
DEV = f"(abs(calories - {ATWATER})::DOUBLE / {ATWATER} * 100)"
ACCURACY = f""", acc AS (SELECT * FROM (
 SELECT item_id, nutrition_id, 'fiber_gt_carbs' AS check_name, 'HIGH' AS severity, 'fiber' AS field, fiber AS cur, CAST(floor(carbs * 0.1::DOUBLE + 0.5) AS INT) AS sug, true AS fixable FROM wide WHERE fiber > carbs
 UNION ALL SELECT item_id, nutrition_id, 'sugar_gt_carbs', 'HIGH', 'sugar', sugar, carbs, true FROM wide WHERE sugar > carbs
 UNION ALL SELECT item_id, nutrition_id, 'sodium_extreme', 'HIGH', 'sodium', sodium, CAST(floor(sodium / 10 + 0.5) AS INT), true FROM wide WHERE sodium > 10000
 {' '.join(f"UNION ALL SELECT item_id, nutrition_id, 'negative_value', 'HIGH', '{f}', {f}, 0, true FROM wide WHERE {f} < 0" for f in ('calories', 'carbs', 'fat', 'protein', 'sugar', 'fiber'))}
 UNION ALL SELECT item_id, nutrition_id, 'calories_extreme', 'HIGH', 'calories', calories, NULL, false FROM wide WHERE calories > 5000
 UNION ALL SELECT item_id, nutrition_id, 'atwater_deviation', CASE WHEN {DEV} > 50 AND abs(calories - {ATWATER}) >= 50 THEN 'HIGH' ELSE 'MEDIUM' END, 'calories', calories, {ATWATER}, false FROM wide
   WHERE calories > 0 AND {ATWATER} > 0 AND NOT {ALCOHOLIC} AND (({DEV} > 50 AND abs(calories - {ATWATER}) >= 50) OR ({DEV} > CASE WHEN {BEVERAGE} THEN 30 ELSE 20 END AND abs(calories - {ATWATER}) >= 30))
 UNION ALL SELECT item_id, nutrition_id, 'zero_fat_fried', 'MEDIUM', 'fat', 0, NULL, false FROM wide WHERE fat = 0 AND (is_fried OR {rx(NAME, detect.FRIED_PASTRY)})
 UNION ALL SELECT item_id, nutrition_id, 'zero_protein_meat', 'MEDIUM', 'protein', 0, NULL, false FROM wide WHERE protein = 0 AND {rx(NAME, detect.MEAT)}))"""


@query("accuracy_findings", ACCURACY + "SELECT item_id, check_name, severity, field, CAST(cur AS VARCHAR) AS current_value, CAST(sug AS VARCHAR) AS suggested_value FROM acc")
def accuracy_findings(cat):
    return audit.check_accuracy(cat.wide).select("item_id", "check_name", "severity", "field", "current_value", "suggested_value")


@query("accuracy_stats", ACCURACY + "SELECT (SELECT count(*) FROM wide WHERE nutrition_id IS NOT NULL) AS checked, (SELECT count(*) FROM wide WHERE nutrition_id IS NOT NULL) - (SELECT count(DISTINCT item_id) FROM acc) AS clean, (SELECT count(DISTINCT item_id) FROM acc) AS flagged")
def accuracy_stats(cat):
    return audit.accuracy_stats(cat.wide, audit.check_accuracy(cat.wide))


@query("accuracy_fixes", ACCURACY + "SELECT nutrition_id, field, cur AS before, sug AS after FROM acc WHERE fixable")
def accuracy_fixes(cat):
    return audit.accuracy_fixes(audit.check_accuracy(cat.wide)).drop("reason", "check_no")


@query("findings_tally", ACCURACY + "SELECT check_name, count(*) FILTER (severity = 'HIGH') AS HIGH, count(*) FILTER (severity = 'MEDIUM') AS MEDIUM, count(*) FILTER (severity = 'LOW') AS LOW FROM acc GROUP BY 1")
def findings_tally(cat):
    return audit.tally(audit.check_accuracy(cat.wide)).select("check_name", "HIGH", "MEDIUM", "LOW")


@query("report_rows", ACCURACY + """, j AS (SELECT a.*, w.park_name, row_number() OVER (PARTITION BY park_name ORDER BY severity <> 'HIGH', a.item_id, check_name, field) AS r, count(*) OVER (PARTITION BY park_name) AS total FROM acc a JOIN wide w USING (item_id))
 SELECT park_name, item_id, check_name, field, r AS rank, greatest(0, total - 10) AS more FROM j WHERE r <= 10""")
def report_rows(cat):
    return audit.report_rows(audit.check_accuracy(cat.wide)).select("park_name", "item_id", "check_name", "field", F.col("r").cast("bigint").alias("rank"), "more")


@query("first_per_issue", ACCURACY + "SELECT name, check_name, min(item_id) AS item_id FROM acc JOIN wide USING (item_id) GROUP BY ALL")
def first_per_issue(cat):
    return audit.first_per_issue(audit.check_accuracy(cat.wide)).select("name", "check_name", "item_id")


# --- completeness, staleness -----------------------------------------------------------------

@query("completeness_findings", f""", pl AS (SELECT coalesce(park_name, 'Unknown Park') AS park, coalesce(restaurant_name, 'Unknown Restaurant') AS restaurant, count(*) n, count(*) FILTER (coalesce(calories, 0) = 0) z, count(*) FILTER (confidence_score < 30) l FROM wide GROUP BY ALL),
 pk AS (SELECT park, count(*) rs, sum(n) n, sum(z) z, sum(l) l, {_first_sql('lower(park)', detect.PARK_TYPES, 'other')} AS kind FROM pl GROUP BY park)
 SELECT park, '' AS restaurant, 'sparse_park' AS check_name, 'HIGH' AS severity, CAST(rs AS VARCHAR) AS current_value FROM pk WHERE rs < CASE kind WHEN 'theme-park' THEN 10 WHEN 'district' THEN 10 WHEN 'cruise-ship' THEN 5 WHEN 'water-park' THEN 2 ELSE 1 END
 UNION ALL SELECT park, '', 'null_calorie_coverage', 'HIGH', printf('%.1f%%', z * 100.0::DOUBLE / n) FROM pk WHERE z * 100.0 / n > 30
 UNION ALL SELECT park, '', 'low_confidence', 'MEDIUM', CAST(l::BIGINT AS VARCHAR) FROM pk WHERE l > 0
 UNION ALL SELECT park, restaurant, 'sparse_restaurant', 'MEDIUM', CAST(n AS VARCHAR) FROM pl WHERE n < 3""")
def completeness_findings(cat):
    return audit.check_completeness(cat.wide)


@query("stale_parks", """, s AS (SELECT coalesce(park_name, 'Unknown Park') AS park, item_id, name, confidence_score, row_number() OVER (PARTITION BY park_name ORDER BY item_id) r FROM wide WHERE confidence_score < 50)
 SELECT park, count(*) AS items, string_agg(name, ', ' ORDER BY item_id) FILTER (r <= 3) AS samples FROM s GROUP BY park HAVING count(*) >= 10""")
def stale_parks(cat):
    return audit.check_stale(cat.wide).select("park", "items", "samples")


@query("source_health", """SELECT s_name AS park, CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE 'degraded' END AS current_value FROM supplier WHERE s_acctbal < 2000""")
def source_health(cat):
    status = cat.table("supplier").select(
        F.col("s_name").alias("name"), F.lit("balance too low").alias("note"),
        F.when(F.col("s_acctbal") < 0, "blocked").when(F.col("s_acctbal") < 2000, "degraded").otherwise("operational").alias("status"))
    return audit.check_sources(status).select("park", "current_value")


# --- full audit -------------------------------------------------------------------------------

_SHARE = f"abs({ATWATER} - calories)::DOUBLE / calories"
_MACROS = "calories > 0 AND fat IS NOT NULL AND carbs IS NOT NULL AND protein IS NOT NULL"


@query("consistency_findings", TYPED + findings([
    ("caloric-math", f"CASE WHEN abs({ATWATER} - calories) > 200 THEN 'HIGH' ELSE 'MEDIUM' END", f"calories > 0 AND {_SHARE} > 0.25::DOUBLE AND abs({ATWATER} - calories) > 50"),
    ("macro-ratio-fried", "MEDIUM", f"{_MACROS} AND is_fried AND fat * 9 * 100.0 / calories < 20 AND calories > 100"),
    ("macro-ratio-dessert", "LOW", f"{_MACROS} AND category = 'dessert' AND carbs * 4 * 100.0 / calories < 30 AND calories > 100"),
    ("macro-ratio-protein", "MEDIUM", f"{_MACROS} AND list_has_any(food_types, ['steak', 'turkey_leg', 'chicken', 'ribs', 'seafood', 'pork']) AND protein * 4 * 100.0 / calories < 15 AND calories > 200"),
    ("low-sodium-savory", "MEDIUM", "category IN ('entree', 'snack') AND sodium < 150 AND calories > 300 AND NOT contains(lower(coalesce(description, '')), 'sweet')"),
    ("high-sodium-dessert", "HIGH", f"category = 'dessert' AND sodium > 1000 AND calories > 0 AND NOT {rx(NAME, 'pretzel|salted caramel|sea salt|bacon')}"),
    ("extreme-sodium", "HIGH", "sodium > 3000 AND calories > 0"),
    ("sugar-exceeds-carbs", "HIGH", "sugar > carbs AND calories IS NOT NULL"), ("fiber-exceeds-carbs", "HIGH", "fiber > carbs AND calories IS NOT NULL"),
    ("negative-values", "HIGH", "calories < 0 OR (calories IS NOT NULL AND (fat < 0 OR carbs < 0 OR protein < 0))"),
    ("implausibly-low-cal", "HIGH", "calories > 0 AND calories < 20 AND category = 'entree'"),
], "typed"))
def consistency_findings(cat):
    return short(audit.check_consistency(cat.wide))


_RANGES = "(VALUES " + ", ".join(f"('{t}', {lo}, {hi})" for t, (lo, hi) in foods.CALORIE_RANGES.items()) + ") r(t, lo, hi)"


@query("plausibility_findings", TYPED + f""", ex AS (SELECT item_id, calories, unnest(food_types) AS t, generate_subscripts(food_types, 1) AS pos FROM typed WHERE calories <> 0),
 hit AS (SELECT item_id, calories, t, lo, hi FROM ex JOIN {_RANGES} USING (t) WHERE calories < lo * 0.7::DOUBLE OR calories > hi * 1.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) = 1)
 SELECT item_id, CASE WHEN calories < lo * 0.7::DOUBLE THEN 'below-range' ELSE 'above-range' END AS check_name, CASE WHEN calories < lo * 0.5::DOUBLE OR calories > hi * 1.5::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM hit UNION ALL """ + findings([
    ("benchmark-coffee", "HIGH", f"{rx(NAME, '^(brewed |hot )?coffee$')} AND calories > 80"), ("benchmark-water", "HIGH", f"{rx(NAME, '^(bottled |spring |sparkling )?water$')} AND calories > 5"),
    ("benchmark-edamame", "MEDIUM", f"{NAME} = 'edamame' AND calories <> 0 AND (calories > 400 OR calories < 80)"), ("benchmark-salad", "MEDIUM", f"{rx(NAME, '^(side |garden |house )?salad$')} AND calories > 500"),
    ("benchmark-fruit", "MEDIUM", f"{rx(NAME, 'fresh fruit|fruit cup|fruit platter')} AND calories > 400")]))
def plausibility_findings(cat):
    return short(audit.check_plausibility(cat.wide))


@query("round_number_findings", """SELECT item_id, 'round-numbers' AS check_name, 'LOW' AS severity FROM wide WHERE calories > 50 AND (calories > 0)::INT + coalesce((carbs > 0)::INT, 0) + coalesce((fat > 0)::INT, 0) + coalesce((protein > 0)::INT, 0) >= 3
 AND calories % 10 = 0 AND (coalesce(carbs, 0) <= 0 OR carbs % 10 = 0) AND (coalesce(fat, 0) <= 0 OR fat % 10 = 0) AND (coalesce(protein, 0) <= 0 OR protein % 10 = 0)""")
def round_number_findings(cat):
    return short(audit.check_round_numbers(cat.wide))


# --- ratio bands, profiles -----------------------------------------------------------------------

_R = f"(coalesce(calories, 0)::DOUBLE / {ATWATER0})"
RATIO_FINDINGS = findings([
    ("caloric-math", f"CASE WHEN {GAP_AWARE} AND {_R} > 1 THEN 'LOW' WHEN {_R} < 0.5 OR {_R} > 2 THEN 'HIGH' WHEN calories < 100 AND abs(calories - {ATWATER0}) < 50 THEN 'LOW' ELSE 'MEDIUM' END",
     f"calories > 50 AND {ATWATER0} > 50 AND ({_R} < 0.75 OR {_R} > 1.35::DOUBLE)"),
    ("macro-ratio-fried", "MEDIUM", "calories > 100 AND is_fried AND fat > 0 AND fat * 9 * 100.0 / calories < 20"),
    ("macro-ratio-dessert", "LOW", "calories > 100 AND category = 'dessert' AND carbs > 0 AND carbs * 4 * 100.0 / calories < 30"),
    ("macro-ratio-protein", "MEDIUM", f"calories > 100 AND {rx(NAME, 'turkey leg|chicken dinner|grilled (chicken|steak|salmon|fish)|ribeye|rib.eye|filet|tenderloin|pork chop')} AND protein > 0 AND protein * 4 * 100.0 / calories < 15"),
    ("sodium-savory", "LOW", rf"calories > 200 AND category = 'entree' AND sodium > 0 AND sodium < 200 AND NOT {rx(NAME, detect.DESSERT_LIKE)} AND NOT {rx(NAME, 'fruit|smoothie|juice|tea' + chr(92) + 'b|coffee|water|milk|açaí|acai')}"),
    ("sodium-dessert", "MEDIUM", f"calories > 200 AND category = 'dessert' AND sodium > 1500 AND NOT {rx(NAME + chr(32) + '||' + chr(32) + 'coalesce(lower(description), chr(32))', 'pretzel|salted|salt|caramel')}"),
    ("sugar-carbs", "HIGH", "sugar > carbs AND carbs > 0"), ("fiber-carbs", "HIGH", "fiber > carbs AND carbs > 0")])


@query("ratio_findings", RATIO_FINDINGS)
def ratio_findings(cat):
    return short(audit.check_ratios(cat.wide))


def rules_sql(rules, columns) -> str:
    """Rule table as rows; the checking SQL joins all rules and keeps the lowest number."""
    def lit(v):
        return quoted(v) if isinstance(v, str) or v is None else str(v)

    return "(VALUES " + ", ".join(
        f"({i}, {looks.parts(r.include)}, {quoted(r.exclude)}, {', '.join(lit(v) for v in (r.out if isinstance(r.out, tuple) else (r.out,)))})" for i, r in enumerate(rules, 1)
    ) + f") r(prio, inc, bare, blank, cut, exc, {', '.join(columns)})"


@query("profile_findings", f""", n AS (SELECT DISTINCT {NAME} AS ln FROM wide), m AS (SELECT ln, r.* FROM n JOIN {rules_sql(foods.PROFILES, foods.PROFILE_COLUMNS)} ON {looks.test("ln")} AND NOT coalesce(regexp_matches(ln, exc), false)
   QUALIFY row_number() OVER (PARTITION BY ln ORDER BY prio) = 1), v AS (SELECT item_id, calories AS c, coalesce(carbs, 0) AS cb, coalesce(fat, 0) AS f, coalesce(protein, 0) AS p, m.* FROM wide JOIN m ON {NAME} = ln WHERE calories <> 0)
 SELECT item_id, label, concat_ws('; ', CASE WHEN c < cal_lo * 0.75 THEN 'calories low' END, CASE WHEN c > cal_hi * 1.25 THEN 'calories high' END, CASE WHEN cb > 0 AND cb < carb_lo * 0.6::DOUBLE THEN 'carbs low' END, CASE WHEN cb > carb_hi * 1.4::DOUBLE THEN 'carbs high' END,
  CASE WHEN f > 0 AND f < fat_lo * 0.5 THEN 'fat low' END, CASE WHEN f > fat_hi * 1.5 THEN 'fat high' END, CASE WHEN p > 0 AND p < protein_lo * 0.5 THEN 'protein low' END, CASE WHEN p > protein_hi * 1.5 THEN 'protein high' END) AS issues,
  CASE WHEN c < cal_lo * 0.75 OR c > cal_hi * 1.25 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM v WHERE issues <> ''""")
def profile_findings(cat):
    return audit.check_profiles(cat.wide)


@query("water_findings", rf"SELECT item_id, 'category-ranking' AS check_name, 'MEDIUM' AS severity FROM wide WHERE category = 'beverage' AND {rx(NAME, chr(92) + 'bwater' + chr(92) + 'b')} AND NOT {rx(NAME, audit.WATER_NOT)} AND calories > 20")
def water_findings(cat):
    return short(audit.check_water(cat.wide))


@query("mismatch_bands", f""", rf AS ({RATIO_FINDINGS}) SELECT item_id, CASE WHEN {_R} > 2.5 THEN 'extreme_over' WHEN {_R} < 0.5 THEN 'extreme_under' ELSE 'moderate' END AS band, calories - {ATWATER0} AS gap FROM wide
 WHERE item_id IN (SELECT item_id FROM rf WHERE check_name = 'caloric-math' AND severity = 'HIGH') AND NOT {rx(NAME, audit.MISMATCH_NOT)}""")
def mismatch_bands(cat):
    return audit.mismatch_bands(cat.wide)


# --- math audit ------------------------------------------------------------------------------------

_MDEV = f"(abs(calories - {ATWATER0})::DOUBLE / nullif({ATWATER0}, 0) * 100)"
_DIET, _SODA = rx(NAME, audit.MATH_DIET), f"category = 'beverage' AND {rx(NAME, audit.MATH_SODA)} AND NOT {rx(NAME, audit.MATH_DIET)}"
_SWEET = f"category = 'dessert' AND NOT {rx(NAME, 'sugar.?free')}"
_FRIED = f"category = 'side' AND (is_fried OR {rx(NAME, audit.MATH_FRIED)}) AND calories > 0"
_CORE = "((calories IS NULL)::INT + (carbs IS NULL)::INT + (protein IS NULL)::INT + (fat IS NULL)::INT)"


@query("math_findings", findings([
    ("atwater_calorie", f"CASE WHEN {_MDEV} > 50 THEN 'CRITICAL' WHEN {_MDEV} > 20 THEN 'ERROR' ELSE 'WARNING' END", f"calories > 0 AND {ATWATER0} > 0 AND {_MDEV} > 10"),
    ("atwater_zero_macros", "CRITICAL", f"calories > 0 AND {ATWATER0} = 0"), ("atwater_no_calories", "CRITICAL", f"coalesce(calories, 0) = 0 AND {ATWATER0} > 0"),
    ("impossible_sugar_gt_carbs", "CRITICAL", "sugar > carbs"), ("impossible_fiber_gt_carbs", "CRITICAL", "fiber > carbs"),
    *(("impossible_negative", "CRITICAL", f"{f} < 0") for f in ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium", "cholesterol")),
    ("plausibility_entree_too_low", "CRITICAL", "category = 'entree' AND calories > 0 AND calories < 100"), ("plausibility_entree_too_high", "ERROR", "category = 'entree' AND calories > 3000"),
    ("plausibility_meat_low_protein", "ERROR", f"category = 'entree' AND protein < 5 AND {rx(NAME, audit.MATH_MEAT)}"), ("plausibility_starch_zero_carbs", "ERROR", f"category = 'entree' AND carbs = 0 AND {rx(NAME, audit.MATH_STARCH)}"),
    ("plausibility_diet_drink_calories", "WARNING", f"category = 'beverage' AND {_DIET} AND calories > 15"), ("plausibility_soda_low_carbs", "ERROR", f"{_SODA} AND carbs < 15"),
    ("plausibility_soda_has_fat", "ERROR", f"{_SODA} AND fat > 3"), ("plausibility_soda_has_protein", "ERROR", f"{_SODA} AND protein > 3"),
    ("plausibility_dessert_too_low", "ERROR", "category = 'dessert' AND calories > 0 AND calories < 50"), ("plausibility_dessert_low_carbs", "ERROR", f"{_SWEET} AND carbs < 10"),
    ("plausibility_dessert_no_sugar", "ERROR", f"{_SWEET} AND sugar = 0"), ("plausibility_fried_low_fat", "ERROR", f"{_FRIED} AND fat < 5"), ("plausibility_fried_low_carbs", "ERROR", f"{_FRIED} AND carbs < 10"),
    ("plausibility_extreme_sodium", "ERROR", "sodium > 5000"),
    ("round_values", "INFO", "calories > 0 AND protein > 0 AND carbs > 0 AND fat > 0 AND calories % 5 = 0 AND protein % 5 = 0 AND carbs % 5 = 0 AND fat % 5 = 0"),
    ("exact_atwater", "INFO", f"calories = {ATWATER} AND calories > 50"), ("missing_core_fields", f"CASE WHEN {_CORE} >= 3 THEN 'ERROR' ELSE 'WARNING' END", f"{_CORE} > 0"),
    ("calories_only_no_macros", "ERROR", "calories > 0 AND carbs IS NULL AND protein IS NULL AND fat IS NULL"), ("missing_important_fields", "INFO", "sodium IS NULL AND fiber IS NULL AND sugar IS NULL"),
    ("no_nutrition_record", "ERROR", "nutrition_id IS NULL")]))
def math_findings(cat):
    return short(audit.check_math(cat.wide))


# --- quality issues ------------------------------------------------------------------------------------

_OFF = f"(abs(calories - {ATWATER})::DOUBLE / nullif(calories, 0))"
_ISSUES = ", ".join([
    f"CASE WHEN coalesce(calories, 0) = 0 AND NOT {rx(NAME, foods.ZERO_ENERGY_DRINKS)} THEN 'Missing calories' END",
    f"CASE WHEN calories <> 0 AND {_OFF} > 0.35::DOUBLE AND NOT {rx(NAME, A.QUALITY_ALCOHOL)} THEN 'Caloric math off by ' || CAST(floor({_OFF} * 100 + 0.5) AS INT) || '%' END",
    "CASE WHEN sugar > carbs THEN 'Sugar exceeds carbs' END", "CASE WHEN fiber > carbs THEN 'Fiber exceeds carbs' END",
    *(f"CASE WHEN calories > 0 AND contains({NAME}, '{w}') AND calories < {b} THEN '{w} only ' || calories || ' cal (expected >{b})' END" for w, b in foods.TOO_LOW.items()),
    *(f"CASE WHEN calories > {b} AND (category = '{w}' OR (contains({NAME}, '{w}') AND NOT contains({NAME}, 'platter') AND NOT contains({NAME}, 'combo'))) THEN '{w} at ' || calories || ' cal (expected <{b})' END" for w, b in foods.TOO_HIGH.items()),
    "CASE WHEN is_fried AND fat < 10 THEN 'Fried item has low fat' END", "CASE WHEN category = 'dessert' AND sugar IS NULL THEN 'Dessert missing sugar data' END",
    *(f"CASE WHEN {c} IS NULL THEN 'Missing {c}' END" for c in ("protein", "carbs", "fat", "sodium")),
    "CASE WHEN confidence_score < 35 THEN 'Low confidence: ' || confidence_score END"])
QUALITY = f""", qi AS (SELECT item_id, name, category, calories, concat_ws(' | ', {_ISSUES}) AS issues FROM wide WHERE nutrition_id IS NOT NULL),
 qp AS (SELECT *, CASE WHEN contains(issues, 'Missing calories') THEN 'critical' WHEN regexp_matches(issues, 'math off|exceeds') THEN 'high' WHEN regexp_matches(issues, 'only|Fried|Dessert') THEN 'medium' ELSE 'low' END AS priority FROM qi WHERE issues <> '')"""


@query("quality_issues", QUALITY + "SELECT item_id, issues, priority FROM qp")
def quality_issues(cat):
    return audit.quality_issues(cat.wide).select("item_id", F.array_join("issues", " | ").alias("issues"), "priority")


@query("real_issues", QUALITY + f""", rl AS (SELECT *, {rx(NAME, foods.ZERO_ENERGY_NAMES)} AS legit, {rx(NAME, A.MISMATCH_EXPECTED)} AS expected, category IN ('entree', 'dessert', 'side', 'snack') AS food FROM qp)
 SELECT item_id, priority FROM rl WHERE NOT (legit AND coalesce(calories, 0) = 0) AND NOT (expected AND len(list_filter(string_split(issues, ' | '), lambda i: NOT (contains(i, 'math off') OR contains(i, 'Missing')))) = 0)
 AND ((food AND calories < 50 AND NOT legit) OR contains(issues, 'Sugar exceeds') OR contains(issues, 'Fiber exceeds') OR (contains(issues, 'only') AND NOT expected) OR (calories IS NULL AND food)
  OR (contains(issues, 'math off') AND NOT expected AND CAST(regexp_extract(issues, 'math off by (\\d+)%', 1) AS INT) >= 50)) ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, coalesce(calories, 0), item_id""".replace("\\\\", "\\"))
def real_issues(cat):
    return audit.real_issues(audit.quality_issues(cat.wide)).orderBy(*audit.priority_order()).select("item_id", "priority")


# --- constraints, low values ------------------------------------------------------------------------------

@query("constraint_violations", """SELECT nutrition_id, concat_ws(',', CASE WHEN fiber > carbs THEN 'fiber_lte_carbs' END, CASE WHEN sugar > carbs THEN 'sugar_lte_carbs' END, CASE WHEN calories NOT BETWEEN 0 AND 5000 THEN 'calories_range' END,
 CASE WHEN sodium NOT BETWEEN 0 AND 10000 THEN 'sodium_range' END, CASE WHEN carbs < 0 OR fat < 0 OR protein < 0 OR sugar < 0 OR fiber < 0 THEN 'macros_non_negative' END, CASE WHEN confidence_score NOT BETWEEN 0 AND 100 THEN 'confidence_range' END) AS violations FROM nutrition WHERE violations <> ''""")
def constraint_violations(cat):
    return audit.split_valid(cat.nutrition)[1].select("nutrition_id", F.array_join("violations", ",").alias("violations"))


_HAS = lambda *w: rx(NAME, "|".join(w))
_LIGHT = f"({_HAS('water', 'diet', 'espresso')} OR ({_HAS('coffee')} AND NOT {_HAS('frappe', 'latte')}) OR ({_HAS('tea')} AND NOT {_HAS('sweet')}))"


@query("low_value_findings", f", lv AS (SELECT * FROM wide WHERE calories <> 0 AND NOT {_LIGHT})" + findings([
    ("BUN_LOW_CARBS", "MEDIUM", f"{_HAS('burger', 'sandwich', 'hot dog', 'wrap', 'sub', 'hoagie')} AND carbs < 25 AND calories > 100"), ("HOTDOG_LOW_CAL", "MEDIUM", f"{_HAS('hot dog')} AND calories < 300 AND calories > 50"),
    ("CHILI_LOW_CAL", "MEDIUM", f"{_HAS('chili')} AND NOT {_HAS('sauce', 'oil')} AND calories < 200 AND calories > 50"), ("BURGER_LOW_CAL", "MEDIUM", f"{_HAS('burger')} AND NOT {_HAS('veggie', 'impossible')} AND calories < 400 AND calories > 100"),
    ("PIZZA_LOW_CAL", "MEDIUM", f"({_HAS('pizza')} OR (category = 'entree' AND contains(lower(description), 'pizza'))) AND NOT {_HAS('bread')} AND calories < 250 AND calories > 50"),
    ("MACRO_MATH", "MEDIUM", f"carbs <> 0 AND {ATWATER}::DOUBLE / calories > 2.5 AND calories > 50 AND calories < 400")], "lv"))
def low_value_findings(cat):
    return short(audit.check_low_values(cat.wide))


@query("undercounted", findings([
    ("entree_under_200", "LOW", f"category = 'entree' AND calories > 0 AND calories < 200 AND NOT {_HAS('salad', 'soup', 'water', 'coffee', 'tea')}"),
    ("macros_twice_stated", "LOW", f"category <> 'beverage' AND calories > 0 AND calories < 300 AND carbs > 0 AND protein >= 0 AND fat >= 0 AND {ATWATER}::DOUBLE / calories > 2")]))
def undercounted(cat):
    return short(audit.undercounted(cat.wide))
