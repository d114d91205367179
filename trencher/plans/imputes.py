"""Queries over the imputers."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.functions.vocab import dishes as DI
from trencher.functions.vocab import drinks as D
from trencher.functions.vocab import impute as V
from trencher.functions.vocab import pours as P
from trencher.operators import fixes, impute
from trencher.plans import looks
from trencher.plans.audits import ATWATER, NAME, pairs, rx
from trencher.plans.catalogue import quoted
from trencher.plans.registry import query

BOTH = "(lower(name) || ' ' || lower(coalesce(description, '')))"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return quoted(v)
    return f"{v}::DOUBLE" if isinstance(v, float) else str(v)


def first_rule(alias: str, source: str, rules, columns, text: str = BOTH) -> str:
    """View with the outputs of the first matching rule per row: all rules are joined
    to the distinct texts and the lowest number is kept."""
    rows = ", ".join(
        f"({i}, {looks.parts(r.include)}, {lit(r.also)}, {lit(r.exclude)}, {lit(','.join(r.category)) if r.category else 'NULL'}, "
        + ", ".join(lit(v) for v in (r.out if isinstance(r.out, tuple) else (r.out,))) + ")"
        for i, r in enumerate(rules, 1)
    )
    cols = ", ".join(columns)
    return f""", {alias}_t AS (SELECT DISTINCT {text} AS tx, category AS ct FROM {source}),
 {alias} AS (SELECT tx, ct, {cols} FROM {alias}_t JOIN (VALUES {rows}) r(prio, inc, bare, blank, cut, also, exc, cats, {cols})
  ON {looks.test("tx")} AND coalesce(regexp_matches(tx, also), true) AND NOT coalesce(regexp_matches(tx, exc), false) AND coalesce(list_contains(string_split(cats, ','), ct), true)
  QUALIFY row_number() OVER (PARTITION BY tx, ct ORDER BY prio) = 1)"""


def rnd(x: str) -> str:
    return f"CAST(floor({x} + 0.5::DOUBLE) AS INT)"


def plain(df):
    return df.select("item_id", "field", "before", "after")


def _fill(field: str, rules, where: str, value: str, text: str = BOTH) -> str:
    return f", src AS (SELECT * FROM wide WHERE {where})" + first_rule("ru", "src", rules, ("share",), text) + f"""
 SELECT item_id, '{field}' AS field, {field} AS before, {rnd(value)} AS after FROM src JOIN ru ON ({text}) = tx AND category IS NOT DISTINCT FROM ct"""


@query("fiber_fills", _fill("fiber", V.FIBER, "carbs > 0 AND coalesce(fiber, 0) = 0", "carbs * share"))
def fiber_fills(cat):
    return plain(impute.fill_fiber(cat.wide))


@query("sugar_fills", _fill("sugar", V.SUGAR, "calories > 0 AND carbs > 0 AND coalesce(sugar, 0) = 0", "carbs * share", NAME))
def sugar_fills(cat):
    return plain(impute.fill_sugar(cat.wide))


@query("protein_fills", _fill("protein", V.PROTEIN, "calories > 0 AND coalesce(protein, 0) = 0", "calories * share / 4"))
def protein_fills(cat):
    return plain(impute.fill_protein(cat.wide))


@query("sodium_fills", _fill("sodium", V.SODIUM, "calories > 0 AND coalesce(sodium, 0) = 0", "calories * share", BOTH + " || CASE WHEN is_fried THEN ' fried_item' ELSE '' END"))
def sodium_fills(cat):
    return plain(impute.fill_sodium(cat.wide))


@query("edge_case_fills", ", src AS (SELECT * FROM wide WHERE carbs > 0)" + first_rule("su", "src", V.SUGAR_EDGE, ("s",), NAME) + first_rule("fi", "src", V.FIBER_EDGE, ("f",), NAME) + f"""
 SELECT item_id, 'sugar' AS field, sugar AS before, {rnd('carbs * s')} AS after FROM src JOIN su ON {NAME} = tx AND category = ct WHERE coalesce(sugar, 0) = 0
 UNION ALL SELECT item_id, 'fiber', fiber, {rnd('carbs * f')} FROM src JOIN fi ON {NAME} = tx AND category = ct WHERE coalesce(fiber, 0) = 0""")
def edge_case_fills(cat):
    return plain(impute.refill_edge_cases(cat.wide))


@query("micro_fills", ", src AS (SELECT * FROM wide WHERE calories > 0)" + first_rule("mi", "src", V.MICRO, V.MICRO_COLUMNS, NAME) + f""", j AS (SELECT * FROM src JOIN mi ON {NAME} = tx AND category = ct)
 SELECT item_id, 'sugar' AS field, sugar AS before, {rnd('carbs * sugar_share::DOUBLE')} AS after FROM j WHERE sugar IS NULL AND carbs > 0
 UNION ALL SELECT item_id, 'fiber', NULL, fiber_g::INT FROM j WHERE fiber IS NULL UNION ALL SELECT item_id, 'sodium', NULL, {rnd('calories * sodium_per_cal::DOUBLE')} FROM j WHERE sodium IS NULL
 UNION ALL SELECT item_id, 'cholesterol', NULL, cholesterol_mg::INT FROM j WHERE cholesterol IS NULL
 UNION ALL SELECT item_id, 'confidence_score', confidence_score, least(coalesce(confidence_score, 30), 30) FROM j WHERE (sugar IS NULL AND carbs > 0) OR fiber IS NULL OR sodium IS NULL OR cholesterol IS NULL""")
def micro_fills(cat):
    return plain(impute.fill_micros(cat.wide))


@query("fat_fills", f", src AS (SELECT * FROM wide WHERE fat = 0 AND calories > 50 AND {rx(BOTH, V.FATTY)} AND NOT {rx(BOTH, V.FATTY_NOT)})" + first_rule("fa", "src", V.FAT, ("f",)) + first_rule("pr", "src", V.FAT_PROTEIN, ("p",)) + f"""
 SELECT item_id, 'fat' AS field, fat AS before, {rnd('calories * f / 9')} AS after FROM src JOIN fa ON {BOTH} = tx AND category = ct
 UNION ALL SELECT item_id, 'protein', protein, {rnd('calories * p / 4')} FROM src JOIN pr ON {BOTH} = tx AND category = ct WHERE protein = 0
 UNION ALL SELECT item_id, 'confidence_score', confidence_score, 45 FROM src""")
def fat_fills(cat):
    return plain(impute.fill_fat(cat.wide))


_VALS = ", ".join(V.TEMPLATE_COLUMNS[1:])


@query("template_estimates", ", src AS (SELECT * FROM wide WHERE nutrition_id IS NOT NULL AND calories IS NULL)" + first_rule("te", "src", V.TEMPLATES, ("template", *("t_" + c for c in impute.VALUE_COLUMNS))) + f""",
 j AS (SELECT src.*, te.* EXCLUDE (tx, ct), {rx('lower(trim(name))', V.ZERO_NAMES)} AS z FROM src LEFT JOIN te ON {BOTH} = tx AND category = ct)
 SELECT item_id, CASE WHEN z THEN 'zero' WHEN template IS NOT NULL THEN 'template' ELSE 'worklist' END AS method, CASE WHEN NOT z THEN template END AS template,
 {', '.join(f'CASE WHEN z THEN 0 ELSE t_{c} END AS {c}' for c in impute.VALUE_COLUMNS)}, CASE WHEN z THEN 90 WHEN template IS NOT NULL THEN 30 END AS confidence_score FROM j""")
def template_estimates(cat):
    return impute.template_estimates(cat.wide).drop("nutrition_id")


_DEF = lambda i: "CASE category " + " ".join(f"WHEN '{c}' THEN {v[i]}" for c, v in impute.CATEGORY_DEFAULTS.items()) + f" ELSE {impute.OTHER_DEFAULT[i]} END"


@query("profile_estimates", first_rule("a", "wide", V.TEMPLATES, V.TEMPLATE_COLUMNS, NAME) + first_rule("b", "wide", V.TEMPLATES, V.TEMPLATE_COLUMNS) + f"""
 SELECT w.item_id, CASE WHEN coalesce(a.template, b.template) IS NOT NULL THEN 'profile' ELSE 'default' END AS method, {', '.join(f'coalesce(a.{c}, b.{c}, {_DEF(i)}) AS {c}' for i, c in enumerate(impute.VALUE_COLUMNS))}
 FROM wide w LEFT JOIN a ON {NAME} = a.tx AND category = a.ct LEFT JOIN b ON {BOTH} = b.tx AND category = b.ct""")
def profile_estimates(cat):
    return impute.profile_estimates(cat.wide)


# --- ingredients -------------------------------------------------------------------------

def _dish_sql() -> str:
    whens = []
    for kind, inc, exc, anywhere, category in DI.DISH_RULES:
        whens.append(" AND ".join(filter(None, [rx(NAME, inc), f"NOT {rx(NAME, exc)}" if exc else "", rx(BOTH, anywhere) if anywhere else "", f"category = '{category}'" if category else ""])) + f" THEN '{kind}'")
    for kind, inc, exc in DI.COOKED_RULES:
        whens.append(" AND ".join(filter(None, ["category = 'entree'", rx(NAME, inc), rx(NAME, DI.PROTEIN_WORDS), f"NOT {rx(NAME, exc)}" if exc else ""])) + f" THEN '{kind}'")
    whens += [f"category = '{c}' THEN '{k}'" for c, k in DI.CATEGORY_TYPES.items()]
    return "CASE " + " ".join("WHEN " + w for w in whens) + " ELSE 'generic_entree' END"


DISH_TYPE = _dish_sql()
_DISHES = "(VALUES " + ", ".join(f"('{k}', {', '.join(lit(v) for v in vals)})" for k, vals in DI.DISHES.items()) + f") dp(dish_type, {', '.join(DI.DISH_FIELDS)})"
_DESC = "lower(coalesce(description, ''))"
_ING = "(VALUES " + ", ".join(f"('{n}', {c}, {quoted(i)}, {lit(x)})" for n, c, i, x in DI.INGREDIENTS) + ") g(ing, cal, inc, exc)"
_RICH = "(VALUES " + ", ".join(f"({worth}, '{w}')" for worth, words in DI.RICH_WORDS for w in words) + ") k(worth, word)"
_SIDE = "(VALUES " + ", ".join(f"('{n}', {quoted(p)})" for n, p in DI.SIDE_NAMES.items()) + ") sn(ing, pat)"


@query("dish_types", f"SELECT item_id, {DISH_TYPE} AS dish_type FROM wide")
def dish_types(cat):
    return cat.wide.select("item_id", impute.dish_type().alias("dish_type"))


@query("ingredient_estimates", f""", src AS (SELECT w.*, dp.* EXCLUDE (dish_type), d.dish_type, {_DESC} AS de FROM wide w JOIN (SELECT item_id, {DISH_TYPE} AS dish_type FROM wide) d USING (item_id) JOIN {_DISHES} ON dp.dish_type = d.dish_type
   WHERE calories > 0 AND NOT (coalesce(confidence_score, 0) >= 80 AND source = 'official') AND NOT (category = 'beverage' OR {pairs(NAME, D.DISH_NOT_DRINK)}) AND NOT {rx('trim(lower(name))', DI.NOT_A_DISH)}),
 rich AS (SELECT item_id, count(*) AS hits, sum(worth) AS expected FROM src JOIN {_RICH} ON contains(de, word) GROUP BY 1),
 ing AS (SELECT item_id, sum(cal) AS added FROM (SELECT DISTINCT item_id, name, dish_type, implied, g.ing, cal FROM src JOIN {_ING} ON regexp_matches(de, inc) AND NOT coalesce(regexp_matches(de, exc), false)) q LEFT JOIN {_SIDE} ON sn.ing = q.ing
   WHERE NOT list_contains(string_split(implied, ' '), q.ing) AND NOT coalesce(dish_type = 'side' AND regexp_matches(lower(name), pat), false) GROUP BY 1),
 e AS (SELECT src.*, coalesce(hits, 0) AS hits, greatest(coalesce(expected, 0), CASE category WHEN 'entree' THEN 400 WHEN 'dessert' THEN 200 WHEN 'snack' THEN 150 ELSE 0 END)::BIGINT AS expected, coalesce(added, 0) AS added FROM src LEFT JOIN rich USING (item_id) LEFT JOIN ing USING (item_id)),
 t AS (SELECT *, dish_type NOT IN ('generic_entree', 'appetizer', 'dessert', 'side') AND calories < min_cal AS by_name FROM e),
 n AS (SELECT *, least({rnd(f"(base + added) * (CASE WHEN {rx(BOTH, DI.FRIED_METHOD)} THEN 1.25 ELSE 1.0 END)::DOUBLE")}, max_cal) AS nc FROM t WHERE by_name OR (length(description) >= 15 AND hits >= 2 AND calories < expected * 0.7::DOUBLE)),
 m AS (SELECT *, {rnd('nc * fat_share / 9')} AS nf, {rnd('nc * carb_share / 4')} AS ncb, {rnd('nc * protein_share / 4')} AS np FROM n), z AS (SELECT *, {rnd('ncb * sugar_share')} AS ns, (np * 4 + ncb * 4 + nf * 9)::DOUBLE / nc AS r FROM m)
 SELECT item_id, dish_type, CASE WHEN by_name THEN 'name' ELSE 'description' END AS method, CASE WHEN CASE WHEN by_name THEN calories < min_cal * 0.5 ELSE calories < expected * 0.5 END THEN 'CRITICAL' ELSE 'SIGNIFICANT' END AS severity,
  nc AS calories, nf AS fat, ncb AS carbs, np AS protein, ns AS sugar, fiber_g AS fiber, sodium_mg AS sodium, CASE WHEN {rx('de', DI.ANIMAL_WORDS)} THEN 75 ELSE 15 END AS cholesterol FROM z WHERE r BETWEEN 0.85::DOUBLE AND 1.15::DOUBLE AND ns <= ncb AND nf >= 3""")
def ingredient_estimates(cat):
    return impute.ingredient_estimates(cat.wide).drop("nutrition_id")


# --- portions ------------------------------------------------------------------------------

class Test(str):
    """SQL text with the operators the portion rules use."""

    def __and__(self, other):
        return Test(f"({self} AND {other})")

    def __or__(self, other):
        return Test(f"({self} OR {other})")


def _words(column: str):
    return lambda *words: Test("(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")")


def _portion_sql() -> tuple[str, str]:
    rules = impute.portion_rules(_words(NAME), _words(_DESC), lambda c: Test(f"category = '{c}'"))
    rules += [("contains(park_name, 'Festival')", 1.3, "appetizer_festival_booth"), ("category = 'entree'", 1.5, "entree_dinner_plate_general"), ("category = 'side'", 1.3, "side_dish"), ("category = 'snack'", 1.4, "snack_oversized")]
    case = lambda i, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {lit(r[i])}" for r in rules) + f" ELSE {other} END"
    return case(1, "1.3::DOUBLE"), case(2, "'default'")


_FACTOR, _LABEL = _portion_sql()
_OVER = "(VALUES " + ", ".join(f"({i}, {', '.join(lit(v) for v in o)})" for i, o in enumerate(V.OVERRIDES)) + ") o(prio, word, calories, carbs, fat, protein, sodium)"


@query("portion_adjustments", f""", ov AS (SELECT w.item_id, o.* FROM wide w JOIN {_OVER} ON contains({NAME}, o.word) WHERE coalesce(w.calories, 0) <> 0 QUALIFY row_number() OVER (PARTITION BY w.item_id ORDER BY prio) = 1),
 pf AS (SELECT *, {_FACTOR} AS factor, {_LABEL} AS label FROM wide WHERE coalesce(calories, 0) <> 0 AND item_id NOT IN (SELECT item_id FROM ov)),
 ps AS (SELECT * FROM pf WHERE factor > 1 AND ({rnd('calories * factor')} <= 3000 OR {rx(NAME, 'kitchen sink|sampler|platter')}))
 {' UNION ALL '.join(f"SELECT ov.item_id, '{f}' AS field, w.{f} AS before, ov.{f} AS after, 'specific_override' AS reason FROM ov JOIN wide w USING (item_id) WHERE ov.{f} IS NOT NULL" for f in ('calories', 'carbs', 'fat', 'protein', 'sodium'))}
 UNION ALL SELECT item_id, 'confidence_score', w.confidence_score, 80, 'specific_override' FROM ov JOIN wide w USING (item_id)
 {' '.join(f"UNION ALL SELECT item_id, '{f}', {f}, {rnd(f'{f} * factor')}, label FROM ps WHERE {f} <> 0" for f in impute.SCALED)}""")
def portion_adjustments(cat):
    return impute.adjust_portions(cat.wide).drop("nutrition_id")


# --- alcohol -----------------------------------------------------------------------------------

_PIPE = "(lower(name) || ' | ' || lower(coalesce(description, '')))"
_TARGETS = {"name": NAME, "both": _PIPE, "beer": f"regexp_replace({_PIPE}, '{P.SOFT_BEERS}', '', 'g')"}
DRINK_CLASS = "CASE " + " ".join(
    "WHEN " + rx(_TARGETS[s], i) + (f" AND NOT {rx(_PIPE, x)}" if x else "") + (f" AND {rx(_PIPE, a)}" if a else "") + f" THEN '{c}'" for c, s, i, x, a in P.DRINK_CLASSES
) + " END"
_STD = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in P.STANDARD_GRAMS.items()) + ") st(drink_class, std)"


@query("drink_classes", f"SELECT item_id, {DRINK_CLASS} AS drink_class FROM wide WHERE category = 'beverage'")
def drink_classes(cat):
    return cat.wide.where("category = 'beverage'").select("item_id", impute.drink_class().alias("drink_class"))


@query("alcohol_estimates", f""", c AS (SELECT *, {DRINK_CLASS} AS drink_class, calories - (4 * coalesce(carbs, 0) + 9 * coalesce(fat, 0) + 4 * coalesce(protein, 0)) AS gap FROM wide WHERE category = 'beverage' AND nutrition_id IS NOT NULL AND coalesce(alcohol_grams, 0) <= 0)
 SELECT item_id, drink_class, CASE WHEN std = 0 THEN 0 WHEN calories > 0 AND gap > 0 AND {rnd('gap / 7.0::DOUBLE')} BETWEEN std * 0.6::DOUBLE AND std * 1.5 THEN {rnd('gap / 7.0::DOUBLE')} ELSE std END AS grams FROM c JOIN {_STD} USING (drink_class)""")
def alcohol_estimates(cat):
    return impute.estimate_alcohol(cat.wide).drop("nutrition_id")


def _pour(text: str, kind: str) -> str:
    lo, hi = (4, 32) if kind == "beer" else (2, 12)
    oz = f"try_cast(regexp_extract({text}, '{P.OUNCES}', 1) AS INT)"
    rest = {
        "beer": f"WHEN {rx(text, chr(92) + 'bpint' + chr(92) + 'b')} THEN 16 WHEN contains({text}, 'half yard') THEN 18 WHEN {rx(text, chr(92) + 'byard' + chr(92) + 'b')} THEN 36 WHEN contains({text}, 'growler') THEN 64 WHEN contains({text}, 'flight') THEN 16 ELSE 12",
        "wine": f"WHEN contains({text}, 'flight') THEN 8 ELSE 5", "sake": f"WHEN contains({text}, 'flight') THEN 8 WHEN {rx(text, 'carafe|bottle')} THEN 12 ELSE 5",
    }[kind]
    return f"CASE WHEN {oz} BETWEEN {lo} AND {hi} THEN {oz} {rest} END"


_abv = lambda oz, abv: rnd(f"{oz} * 29.5735::DOUBLE * ({abv} / 100) * 0.789::DOUBLE")
_WINES = "(VALUES " + ", ".join(f"({i}, {quoted(p)}, {v}::DOUBLE)" for i, (p, v) in enumerate(P.WINE_ABV)) + ") wi(prio, pat, abv)"
_SPIRITS = f"len(regexp_extract_all({_DESC}, '{P.SPIRITS}'))"
_LIQ = f"len(regexp_extract_all({_DESC}, '{P.LIQUEURS}'))"


@query("pour_sizes", f"SELECT item_id, {_pour(BOTH, 'beer')} AS beer_oz, {_pour(BOTH, 'wine')} AS wine_oz, {_pour(BOTH, 'sake')} AS sake_oz, CASE WHEN {_SPIRITS} + {_LIQ} > 0 THEN (CASE {_SPIRITS} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1.5 WHEN 3 THEN 2 ELSE 2.5 END)::DOUBLE + {_LIQ} * 0.3::DOUBLE END AS shots FROM wide")
def pour_sizes(cat):
    text = impute.both_text()
    return cat.wide.select("item_id", *(impute.pour_ounces(text, k).alias(f"{k}_oz") for k in ("beer", "wine", "sake")), impute.described_shots(F.col("description")).alias("shots"))


@query("alcohol_refinements", ", src AS (SELECT * FROM wide WHERE category = 'beverage' AND alcohol_grams > 0)" + first_rule("ck", "src", P.COCKTAIL_SHOTS, ("shots",), NAME) + first_rule("bb", "src", P.BEER_ABV, ("beer",), f"regexp_replace({BOTH}, 'ginger ale|root beer|birch beer', '', 'g')") + first_rule("lq", "src", P.LIQUEUR_ABV, ("liq",)) + f""",
 wn AS (SELECT item_id, abv FROM src JOIN {_WINES} ON regexp_matches({NAME}, pat) OR ({rx(NAME, P.WINE_NAME)} AND regexp_matches({_DESC}, pat)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY prio) = 1),
 j AS (SELECT src.*, shots, beer, liq, abv, CASE WHEN {_SPIRITS} + {_LIQ} > 0 THEN (CASE {_SPIRITS} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1.5 WHEN 3 THEN 2 ELSE 2.5 END)::DOUBLE + {_LIQ} * 0.3::DOUBLE END AS ds FROM src
  LEFT JOIN ck ON {NAME} = ck.tx AND category = ck.ct LEFT JOIN bb ON regexp_replace({BOTH}, 'ginger ale|root beer|birch beer', '', 'g') = bb.tx AND category = bb.ct LEFT JOIN lq ON {BOTH} = lq.tx AND category = lq.ct LEFT JOIN wn USING (item_id)),
 r AS (SELECT item_id, alcohol_grams AS before, CASE WHEN {rx(NAME, P.FOOD_NOT_DRINK)} THEN 'food' WHEN shots IS NOT NULL THEN 'cocktail_recipe' WHEN contains({BOTH}, 'irish coffee') OR {rx(BOTH, P.LIQUEUR_COFFEE)} THEN 'liqueur_coffee'
   WHEN beer IS NOT NULL THEN 'beer_brand_abv' WHEN ds > 0 THEN 'cocktail_description_parse' WHEN abv IS NOT NULL THEN 'wine_varietal_abv' END AS method,
   CASE method WHEN 'cocktail_recipe' THEN {rnd("(CASE WHEN ds > shots AND ds <= shots * 1.5 THEN ds ELSE shots END) * 14")} WHEN 'liqueur_coffee' THEN CASE WHEN contains({BOTH}, 'irish coffee') THEN 14 ELSE {_abv('1.5::DOUBLE', 'coalesce(liq, 17)')} END
    WHEN 'beer_brand_abv' THEN {_abv(_pour(BOTH, 'beer'), 'beer')} WHEN 'cocktail_description_parse' THEN {rnd('ds * 14')} WHEN 'wine_varietal_abv' THEN {_abv(f"(CASE WHEN {rx(BOTH, P.SAKE)} THEN {_pour(BOTH, 'sake')} ELSE {_pour(BOTH, 'wine')} END)", 'abv')} END AS after FROM j)
 SELECT item_id, method, before, after FROM r WHERE method <> 'food' AND after IS NOT NULL AND after <> before""")
def alcohol_refinements(cat):
    return impute.refine_alcohol(cat.wide).drop("nutrition_id")


# --- allergens, validation, applying ----------------------------------------------------------------

_AL = "(VALUES " + ", ".join(f"('{a}', {quoted(V.allergen_pattern(c))}, {quoted(V.allergen_pattern(m)) if m else 'NULL'}, {lit(x)})" for a, c, m, x in V.ALLERGENS) + ") al(allergen_type, con, may, exc)"


@query("allergen_tags", f""", tx AS (SELECT item_id, lower(concat_ws(' ', name, coalesce(description, ''), category)) AS t FROM items),
 pat AS (SELECT t, allergen_type, CASE WHEN regexp_matches(t, con) THEN 'contains' ELSE 'may_contain' END AS severity FROM (SELECT DISTINCT t FROM tx) JOIN {_AL} ON (regexp_matches(t, con) OR coalesce(regexp_matches(t, may), false)) AND NOT coalesce(regexp_matches(t, exc), false))
 SELECT item_id, allergen_type, severity FROM tx JOIN pat USING (t) WHERE NOT EXISTS (SELECT 1 FROM allergens e WHERE e.item_id = tx.item_id AND e.allergen_type = pat.allergen_type)""")
def allergen_tags(cat):
    return impute.tag_allergens(cat.items, cat.allergens)


_VALID = " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in impute.ESTIMATE_RANGES.items()) + " AND sugar <= carbs AND fiber <= carbs"


@query("accepted_estimates", f"SELECT nutrition_id, calories, carbs, 40 AS confidence_score, 'crowdsourced' AS source FROM nutrition WHERE {_VALID}")
def accepted_estimates(cat):
    return impute.accept_estimates(cat.nutrition)[0].select("nutrition_id", "calories", "carbs", "confidence_score", "source")


@query("rejected_estimates", f"SELECT count(*) AS rejected FROM nutrition WHERE NOT coalesce({_VALID}, false)")
def rejected_estimates(cat):
    return impute.accept_estimates(cat.nutrition)[1].agg(F.count(F.lit(1)).alias("rejected"))


@query("snapped_estimates", f"SELECT nutrition_id, CASE WHEN abs(calories - {ATWATER})::DOUBLE / calories > 0.3::DOUBLE THEN {ATWATER} ELSE calories END AS calories FROM nutrition WHERE {_VALID}")
def snapped_estimates(cat):
    return impute.validated_estimates(cat.nutrition).select("nutrition_id", "calories")


@query("fix_batches", """, f AS (SELECT nutrition_id, 'fiber' AS field, CAST(floor(carbs * 0.1::DOUBLE + 0.5) AS INT) AS after, 1 AS no FROM wide WHERE fiber > carbs UNION ALL SELECT nutrition_id, 'sugar', carbs, 2 FROM wide WHERE sugar > carbs
 UNION ALL SELECT nutrition_id, 'sodium', CAST(floor(sodium / 10 + 0.5) AS INT), 3 FROM wide WHERE sodium > 10000
 """ + " ".join(f"UNION ALL SELECT nutrition_id, '{c}', 0, 4 FROM wide WHERE {c} < 0" for c in ("calories", "carbs", "fat", "protein", "sugar", "fiber")) + """),
 l AS (SELECT nutrition_id, field, arg_max(after, no) AS after, count(*) AS n FROM f WHERE nutrition_id IS NOT NULL GROUP BY ALL)
 SELECT nutrition_id, string_agg(field || '=' || after, ',' ORDER BY field) AS updates, CAST(sum(n) AS BIGINT) AS n_fixes FROM l GROUP BY 1""")
def fix_batches(cat):
    from trencher.operators import audit

    b = fixes.batch(audit.accuracy_fixes(audit.check_accuracy(cat.wide)))
    pairs_ = F.sort_array(F.transform(F.map_entries("updates"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return b.select("nutrition_id", F.array_join(pairs_, ",").alias("updates"), "n_fixes")


@query("fixed_snapshot", """, p AS (SELECT nutrition_id FROM wide) SELECT n.nutrition_id, CASE WHEN p.nutrition_id IS NOT NULL AND calories < 0 THEN 0 ELSE calories END AS calories,
 CASE WHEN p.nutrition_id IS NOT NULL AND fiber > carbs THEN CAST(floor(carbs * 0.1::DOUBLE + 0.5) AS INT) ELSE fiber END AS fiber, CASE WHEN p.nutrition_id IS NOT NULL AND sugar > carbs THEN carbs ELSE sugar END AS sugar,
 CASE WHEN p.nutrition_id IS NOT NULL AND sodium > 10000 THEN CAST(floor(sodium / 10 + 0.5) AS INT) ELSE sodium END AS sodium FROM nutrition n LEFT JOIN p USING (nutrition_id)""")
def fixed_snapshot(cat):
    from trencher.operators import audit

    b = fixes.batch(audit.accuracy_fixes(audit.check_accuracy(cat.wide)))
    return fixes.apply_batch(cat.nutrition, b).select("nutrition_id", "calories", "fiber", "sugar", "sodium")


@query("closed_venues_seasonal", "SELECT item_id, is_seasonal OR coalesce(restaurant_id IN (SELECT restaurant_id FROM restaurants WHERE land = 'Frontierland'), false) AS is_seasonal FROM wide")
def closed_venues_seasonal(cat):
    return fixes.mark_seasonal(cat.wide, cat.restaurants.where("land = 'Frontierland'")).select("item_id", "is_seasonal")


@query("literal_corrections", """, c(name, park_name, only_if_calories, calories, sodium) AS (SELECT DISTINCT lower(name), CASE WHEN p_size % 2 = 0 THEN 'EPCOT' END, NULL::INT, 500 + p_size, NULL::INT FROM items JOIN part ON p_partkey = item_id WHERE p_size < 5)
 SELECT item_id, 'calories' AS field, w.calories AS before, c.calories AS after FROM wide w JOIN c ON lower(w.name) = c.name AND (c.park_name IS NULL OR c.park_name = w.park_name)""")
def literal_corrections(cat):
    sizes = cat.table("part").select(F.col("p_partkey").alias("item_id"), "p_size")
    table = cat.items.join(sizes, "item_id").where("p_size < 5").selectExpr(
        "lower(name) AS name", "CASE WHEN p_size % 2 = 0 THEN 'EPCOT' END AS park_name", "CAST(NULL AS INT) AS only_if_calories", "500 + p_size AS calories", "CAST(NULL AS INT) AS sodium").distinct()
    return plain(fixes.corrections(cat.wide, table))
