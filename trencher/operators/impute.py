"""Imputation of missing values by ordered rules, templates, ingredients and pours.

A gap is null **or** zero unless an imputer says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.detect import dish_is_drink
from trencher.functions.numeric import energy_of, missing, ratio, round_half_up, zero_if_null
from trencher.functions.rules import RuleTable, bound, present
from trencher.functions.text import edges
from trencher.functions.vocab import dishes as DI
from trencher.functions.vocab import impute as V
from trencher.functions.vocab import pours as P
from trencher.operators.fixes import emit
from trencher.operators.matching import spread

NAME = lambda: F.lower("name")


def both_text() -> Column:
    return F.concat(F.lower("name"), F.lit(" "), F.lower(F.coalesce("description", F.lit(""))))


def _share(rules, text: Column) -> Column:
    table = RuleTable(rules, ("share",), types={"share": "double"})
    return table.output(table.first(text, category=F.col("category")), "share")


def _positive(column: str) -> Column:
    return F.col(column) > 0


# --- single nutrient imputers -----------------------------------------------------------

def fill_fiber(wide: DataFrame) -> DataFrame:
    share = _share(V.FIBER, both_text())
    return emit(wide.where(_positive("carbs") & missing(F.col("fiber"))), {"fiber": round_half_up(F.col("carbs") * share)}, "fiber from carbs")


def fill_sugar(wide: DataFrame) -> DataFrame:
    share = _share(V.SUGAR, NAME())
    rows = wide.where(_positive("calories") & _positive("carbs") & missing(F.col("sugar")))
    return emit(rows, {"sugar": round_half_up(F.col("carbs") * share)}, "sugar from carbs")


def fill_protein(wide: DataFrame) -> DataFrame:
    share = _share(V.PROTEIN, both_text())
    rows = wide.where(_positive("calories") & missing(F.col("protein")))
    return emit(rows, {"protein": round_half_up(F.col("calories") * share / 4)}, "protein from calories")


def fill_sodium(wide: DataFrame) -> DataFrame:
    """The fried flag of a snack reads as one more word of its text."""
    text = F.concat(both_text(), F.when(F.col("is_fried"), F.lit(" fried_item")).otherwise(F.lit("")))
    rows = wide.where(_positive("calories") & missing(F.col("sodium")))
    return emit(rows, {"sodium": round_half_up(F.col("calories") * _share(V.SODIUM, text))}, "sodium from calories")


def refill_edge_cases(wide: DataFrame) -> DataFrame:
    sugar = F.when(missing(F.col("sugar")), round_half_up(F.col("carbs") * _share(V.SUGAR_EDGE, NAME())))
    fiber = F.when(missing(F.col("fiber")), round_half_up(F.col("carbs") * _share(V.FIBER_EDGE, NAME())))
    return emit(wide.where(_positive("carbs")), {"sugar": sugar, "fiber": fiber}, "edge case")


MICRO_TABLE = RuleTable(V.MICRO, V.MICRO_COLUMNS, types={c: "double" for c in V.MICRO_COLUMNS})


def fill_micros(wide: DataFrame) -> DataFrame:
    """Null (not zero) sugar, fiber, sodium and cholesterol from one profile; confidence capped at 30."""
    rows = wide.where(_positive("calories")).withColumn("_no", MICRO_TABLE.first(NAME(), category=F.col("category")))
    rows = rows.withColumns({f"_{c}": MICRO_TABLE.output(F.col("_no"), c) for c in V.MICRO_COLUMNS})
    null = lambda c: F.col(c).isNull()
    updates = {
        "sugar": F.when(null("sugar") & _positive("carbs"), round_half_up(F.col("carbs") * F.col("_sugar_share"))),
        "fiber": F.when(null("fiber"), F.col("_fiber_g")),
        "sodium": F.when(null("sodium"), round_half_up(F.col("calories") * F.col("_sodium_per_cal"))),
        "cholesterol": F.when(null("cholesterol"), F.col("_cholesterol_mg")),
    }
    some = F.coalesce(*(u.cast("int") for u in updates.values())).isNotNull()
    updates["confidence_score"] = F.when(some, F.least(F.coalesce("confidence_score", F.lit(30)), F.lit(30)))
    return emit(rows, updates, "micro profile")


def fill_fat(wide: DataFrame) -> DataFrame:
    """Zero fat on fatty foods; zero protein is refilled along the way."""
    text = both_text()
    rows = wide.where((F.col("fat") == 0) & (F.col("calories") > 50) & text.rlike(edges(V.FATTY)) & ~text.rlike(edges(V.FATTY_NOT)))
    return emit(rows, {
        "fat": round_half_up(F.col("calories") * _share(V.FAT, text) / 9),
        "protein": F.when(F.col("protein") == 0, round_half_up(F.col("calories") * _share(V.FAT_PROTEIN, text) / 4)),
        "confidence_score": F.lit(45),
    }, "fatty food without fat")


# --- whole-record estimates -----------------------------------------------------------------

TEMPLATE_TABLE = RuleTable(V.TEMPLATES, V.TEMPLATE_COLUMNS)
VALUE_COLUMNS = V.TEMPLATE_COLUMNS[1:]


def template_estimates(wide: DataFrame) -> DataFrame:
    """Null calories: zero list (confidence 90), else template (30), else the work-list."""
    rows = wide.where(F.col("nutrition_id").isNotNull() & F.col("calories").isNull())
    zero = F.lower(F.trim("name")).rlike(edges(V.ZERO_NAMES))
    rows = rows.withColumn("_no", TEMPLATE_TABLE.first(both_text())).withColumn("_zero", zero)
    method = F.when(F.col("_zero"), "zero").when(F.col("_no").isNotNull(), "template").otherwise("worklist")
    return rows.select(
        "item_id", "nutrition_id", method.alias("method"),
        F.when(~F.col("_zero"), TEMPLATE_TABLE.output(F.col("_no"), "template")).alias("template"),
        *(F.when(F.col("_zero"), 0).otherwise(TEMPLATE_TABLE.output(F.col("_no"), c)).alias(c) for c in VALUE_COLUMNS),
        F.when(F.col("_zero"), 90).when(F.col("_no").isNotNull(), 30).alias("confidence_score"),
    )


# Fallback records per category (calories, carbs, fat, protein, sugar, fiber, sodium).
CATEGORY_DEFAULTS = {
    "entree": (600, 40, 25, 30, 5, 3, 900), "dessert": (400, 50, 18, 4, 35, 1, 200), "snack": (300, 35, 14, 8, 10, 2, 500),
    "beverage": (200, 45, 1, 1, 40, 0, 30), "side": (250, 25, 12, 8, 4, 3, 500),
}
OTHER_DEFAULT = (400, 35, 18, 15, 8, 2, 600)


def profile_estimates(items: DataFrame, table: RuleTable = TEMPLATE_TABLE, defaults=CATEGORY_DEFAULTS, other=OTHER_DEFAULT) -> DataFrame:
    """Profile by name, then by name and description, then the category's default."""
    rows = items.withColumn("_no", F.coalesce(table.first(NAME()), table.first(both_text())))

    def fallback(position: int) -> Column:
        out = F.when(F.lit(False), 0)
        for category, values in defaults.items():
            out = out.when(F.col("category") == category, values[position])
        return out.otherwise(other[position])

    matched = F.when(F.col("_no").isNotNull(), "profile").otherwise("default")
    return rows.select(
        "item_id", matched.alias("method"),
        *(F.coalesce(table.output(F.col("_no"), c), fallback(i)).alias(c) for i, c in enumerate(VALUE_COLUMNS)),
    )


# --- ingredient based -------------------------------------------------------------------------

def dish_type() -> Column:
    name, both = NAME(), both_text()
    out = F.when(F.lit(False), "")
    for kind, include, exclude, anywhere, category in DI.DISH_RULES:
        test = name.rlike(edges(include))
        if exclude:
            test = test & ~name.rlike(edges(exclude))
        if anywhere:
            test = test & both.rlike(edges(anywhere))
        if category:
            test = test & (F.col("category") == category)
        out = out.when(test, kind)
    for kind, include, exclude in DI.COOKED_RULES:
        test = (F.col("category") == "entree") & name.rlike(edges(include)) & name.rlike(edges(DI.PROTEIN_WORDS))
        out = out.when(test & ~name.rlike(edges(exclude)) if exclude else test, kind)
    for category, kind in DI.CATEGORY_TYPES.items():
        out = out.when(F.col("category") == category, kind)
    return out.otherwise("generic_entree")


def with_dish_profile(wide: DataFrame) -> DataFrame:
    rows = bound(wide, dish_type=dish_type())
    kinds = list(DI.DISHES)
    at = F.array_position(F.array(*(F.lit(k) for k in kinds)), F.col("dish_type")).cast("int")
    rows = bound(rows, _at=at)
    return rows.withColumns({
        f: F.try_element_at(F.array(*(F.lit(DI.DISHES[k][i]) for k in kinds)), F.col("_at")) for i, f in enumerate(DI.DISH_FIELDS)
    }).drop("_at")


def ingredient_calories(description: Column) -> Column:
    """Calories added by ingredients the description names, beyond those implied by the dish."""
    by_name: dict[str, tuple[int, Column]] = {}
    for name, cal, include, exclude in DI.INGREDIENTS:
        test = description.rlike(edges(include))
        if exclude:
            test = test & ~description.rlike(edges(exclude))
        by_name[name] = (cal, by_name[name][1] | test) if name in by_name else (cal, test)
    total = F.lit(0)
    for name, (cal, test) in by_name.items():
        counted = test & ~F.array_contains(F.split("implied", " "), name)
        if name in DI.SIDE_NAMES:
            counted = counted & ~((F.col("dish_type") == "side") & NAME().rlike(edges(DI.SIDE_NAMES[name])))
        total = total + F.when(counted, cal).otherwise(0)
    return total


def ingredient_estimates(wide: DataFrame) -> DataFrame:
    """Dishes far too low for their type or description get a fresh estimate, if it holds together."""
    rows = wide.where(
        (F.col("calories") > 0) & ~((F.coalesce("confidence_score", F.lit(0)) >= 80) & (F.col("source") == "official"))
        & ~dish_is_drink() & ~F.trim(NAME()).rlike(edges(DI.NOT_A_DISH))
    )
    description = F.lower(F.coalesce("description", F.lit("")))
    rows = with_dish_profile(rows)
    hits, expected = F.lit(0), F.lit(0)
    for worth, words in DI.RICH_WORDS:
        n = F.lit(0)
        for w in words:
            n = n + F.contains(description, F.lit(w)).cast("int")
        hits, expected = hits + n, expected + n * worth
    rows = bound(rows, _hits=hits, _expected=expected)
    floor = F.when(F.col("category") == "entree", 400).when(F.col("category") == "dessert", 200).when(F.col("category") == "snack", 150).otherwise(0)
    rows = rows.withColumn("_expected", F.greatest("_expected", floor))
    calories = F.col("calories")
    by_name = ~F.col("dish_type").isin(*DI.BROAD_TYPES) & (calories < F.col("min_cal"))
    by_text = (F.length("description") >= 15) & (F.col("_hits") >= 2) & (calories < F.col("_expected") * F.lit(0.7))
    severe = F.when(by_name, calories < F.col("min_cal") * F.lit(0.5)).otherwise(calories < F.col("_expected") * F.lit(0.5))
    rows = rows.where(by_name | F.coalesce(by_text, F.lit(False)))
    factor = F.when(both_text().rlike(edges(DI.FRIED_METHOD)), 1.25).otherwise(1.0)
    rows = bound(rows, _added=ingredient_calories(description))
    rows = bound(rows, new_calories=F.least(round_half_up((F.col("base") + F.col("_added")) * factor), F.col("max_cal")))
    new = F.col("new_calories")
    rows = rows.withColumns({
        "new_fat": round_half_up(new * F.col("fat_share") / 9), "new_carbs": round_half_up(new * F.col("carb_share") / 4),
        "new_protein": round_half_up(new * F.col("protein_share") / 4),
    })
    rows = rows.withColumn("new_sugar", round_half_up(F.col("new_carbs") * F.col("sugar_share")))
    implied = F.col("new_protein") * 4 + F.col("new_carbs") * 4 + F.col("new_fat") * 9
    r = ratio(implied, new)
    return rows.where((r >= 0.85) & (r <= 1.15) & (F.col("new_sugar") <= F.col("new_carbs")) & (F.col("new_fat") >= 3)).select(
        "item_id", "nutrition_id", "dish_type", F.when(by_name, "name").otherwise("description").alias("method"),
        F.when(severe, "CRITICAL").otherwise("SIGNIFICANT").alias("severity"),
        new.alias("calories"), F.col("new_fat").alias("fat"), F.col("new_carbs").alias("carbs"), F.col("new_protein").alias("protein"),
        F.col("new_sugar").alias("sugar"), F.col("fiber_g").alias("fiber"), F.col("sodium_mg").alias("sodium"),
        F.when(description.rlike(edges(DI.ANIMAL_WORDS)), 75).otherwise(15).alias("cholesterol"),
    )


# --- portions -----------------------------------------------------------------------------------

def portion_rules(n, d, c):
    """Ordered portion classes as (test, factor, class).

    ``n``/``d`` build "name/description mentions one of these words", ``c`` "category is".
    """
    spirits = d("vodka", "tequila", "rum", "gin", "bourbon", "whiskey", "brandy", "liqueur")
    frozen = d("frozen", "blended") | n("frozen")
    return [
        (n("cupcake"), 2.5, "dessert_cupcake"),
        (n("kitchen sink"), 1.0, "already_estimated"),
        (n("nacho", "totcho"), 2.2, "nachos_loaded"),
        (n("loaded fries") | (n("fries") & d("topped")), 2.0, "loaded_fries"),
        (n("hot dog", "corn dog", "foot long", "foot-long") & (d("foot", "chili", "loaded", "hash") | n("foot")), 2.0, "hot_dog_footlong"),
        (n("hot dog", "corn dog"), 1.5, "hot_dog_standard"),
        (n("rib", "bbq", "brisket", "smoked") & (d("served with", "beans", "coleslaw", "sides") | n("platter", "sampler", "combo")), 1.8, "bbq_platter"),
        (n("burger", "cheeseburger"), 1.8, "burger_with_fries"),
        (n("burrito"), 1.8, "burrito"),
        (n("sandwich", "wrap", "melt", "sub", "croissant jambon"), 1.7, "sandwich_oversized"),
        (n("tender", "strip", "finger", "nugget") & (d("fries", "french") | c("entree")), 1.6, "chicken_tenders_fries"),
        (d("bread bowl") | n("bread bowl"), 1.6, "soup_bread_bowl"),
        (n("pretzel") & (n("jumbo", "bavarian") | d("jumbo")), 2.0, "pretzel_jumbo"),
        (n("pretzel"), 1.3, "pretzel_standard"),
        (n("pizza", "flatbread"), 1.5, "pizza_personal"),
        (n("spaghetti", "pasta", "mac", "parmigiana", "parmesan"), 1.6, "entree_dinner_plate_quick_service"),
        (n("taco", "fajita"), 1.4, "tacos_order"),
        (n("rice bowl", "poke", "teriyaki", "stir fry", "stir-fry"), 1.5, "rice_bowl_asian"),
        (n("salad"), 1.4, "salad_entree"),
        (c("dessert") & n("sundae", "brownie", "cake", "cookie", "churro"), 2.0, "dessert_specialty"),
        (c("dessert") & n("ice cream", "dole whip", "soft-serve", "soft serve"), 1.5, "frozen_treat"),
        (c("dessert"), 1.8, "dessert_general"),
        (d("scrambled egg", "pancake", "waffle") | n("breakfast", "bounty platter"), 1.5, "breakfast_plate"),
        (c("beverage") & spirits & frozen, 1.5, "cocktail_frozen_specialty"),
        (c("beverage") & spirits, 1.2, "cocktail_standard"),
        (c("beverage") & (d("frozen", "slush", "smoothie", "blend") | n("freeze", "slush", "boba")), 1.3, "frozen_drink_nonalcoholic"),
        (c("beverage") & n("coffee", "latte", "cappuccino", "americano", "cold brew", "nitro", "mocha", "chai"), 1.0, "coffee_standard"),
        (c("beverage") & n("beer", "lager", "ale", "wine"), 1.0, "beer_wine_standard"),
        (n("butterbeer"), 1.3, "frozen_drink_nonalcoholic"),
        (c("beverage"), 1.1, "beverage_general"),
    ]


SCALED = ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium", "cholesterol")


def adjust_portions(wide: DataFrame) -> DataFrame:
    """Literal overrides first (confidence 80), else every nutrient times the class factor."""
    name, desc = NAME(), F.lower(F.coalesce("description", F.lit("")))
    any_of = lambda target: lambda *words: target.rlike(edges("|".join(words)))
    rules = portion_rules(any_of(name), any_of(desc), lambda category: F.col("category") == category)
    factor, label = F.when(F.lit(False), 0.0), F.when(F.lit(False), "")
    number = F.when(F.lit(False), 0)
    for i, (test, _, _) in enumerate(rules, start=1):
        number = number.when(test, i)
    festival = F.coalesce("park_name", F.lit("")).rlike("Festival|Event")
    tail = [(festival, 1.3, "appetizer_festival_booth"), (F.col("category") == "entree", 1.5, "entree_dinner_plate_general"),
            (F.col("category") == "side", 1.3, "side_dish"), (F.col("category") == "snack", 1.4, "snack_oversized")]
    for i, (test, _, _) in enumerate(tail, start=len(rules) + 1):
        number = number.when(test, i)
    all_rules = rules + tail + [(None, 1.3, "default")]
    number = number.otherwise(len(all_rules))
    rows = wide.where(zero_if_null(F.col("calories")) != 0).withColumn("_no", number)
    factor = F.try_element_at(F.array(*(F.lit(f) for _, f, _ in all_rules)), F.col("_no"))
    label = F.try_element_at(F.array(*(F.lit(x) for _, _, x in all_rules)), F.col("_no"))
    override = F.when(F.lit(False), 0)
    for i, (word, *_) in enumerate(V.OVERRIDES, start=1):
        override = override.when(F.contains(name, F.lit(word)), i)
    rows = rows.withColumns({"_override": override, "_factor": factor, "_label": label})
    fixed = rows.where("_override IS NOT NULL")
    pick = lambda i: F.try_element_at(F.array(*(F.lit(o[i]).cast("int") for o in V.OVERRIDES)), F.col("_override"))
    overridden = emit(fixed, {
        "calories": pick(1), "carbs": pick(2), "fat": pick(3), "protein": pick(4), "sodium": pick(5), "confidence_score": F.lit(80),
    }, "specific_override")
    scaled = round_half_up(F.col("calories") * F.col("_factor"))
    shareable = name.rlike("kitchen sink|sampler|platter")
    rest = rows.where(F.col("_override").isNull() & (F.col("_factor") > 1.0) & ((scaled <= 3000) | shareable))
    updates = {"calories": scaled} | {
        c: F.when(F.col(c) != 0, round_half_up(F.col(c) * F.col("_factor"))) for c in SCALED if c != "calories"
    }
    return overridden.unionByName(emit(rest, updates, F.col("_label")))


# --- alcohol -----------------------------------------------------------------------------------------

def drink_class() -> Column:
    """First class that fires; null for drinks without alcohol in sight."""
    name = F.lower(F.coalesce("name", F.lit("")))
    both = F.concat(name, F.lit(" | "), F.lower(F.coalesce("description", F.lit(""))))
    targets = {"name": name, "both": both, "beer": F.regexp_replace(both, P.SOFT_BEERS, "")}
    out = F.when(F.lit(False), "")
    for label, scope, include, exclude, also in P.DRINK_CLASSES:
        test = targets[scope].rlike(edges(include))
        if exclude:
            test = test & ~both.rlike(edges(exclude))
        if also:
            test = test & both.rlike(edges(also))
        out = out.when(test, label)
    return out


def estimate_alcohol(wide: DataFrame) -> DataFrame:
    """Grams for beverages without any: the unexplained energy where it is near the class standard."""
    rows = wide.where((F.col("category") == "beverage") & F.col("nutrition_id").isNotNull() & ~(zero_if_null(F.col("alcohol_grams")) > 0))
    rows = rows.withColumn("drink_class", drink_class()).where("drink_class IS NOT NULL")
    standard = F.try_element_at(F.create_map(*(F.lit(x) for p in P.STANDARD_GRAMS.items() for x in p)), F.col("drink_class"))
    rows = rows.withColumn("standard", standard)
    macros = zero_if_null(F.col("carbs")) * 4 + zero_if_null(F.col("fat")) * 9 + zero_if_null(F.col("protein")) * 4
    gap = F.col("calories") - macros
    grams = round_half_up(gap / 7)
    near = (F.col("calories") > 0) & (gap > 0) & (grams >= F.col("standard") * F.lit(0.6)) & (grams <= F.col("standard") * F.lit(1.5))
    return rows.select(
        "item_id", "nutrition_id", "drink_class",
        F.when(F.col("standard") == 0, 0).when(near, grams).otherwise(F.col("standard")).alias("grams"),
    )


def grams_from_volume(ounces: Column, abv: Column) -> Column:
    return round_half_up(ounces * F.lit(P.ML_PER_OZ) * (abv / 100) * F.lit(P.ETHANOL_DENSITY))


def grams_from_shots(shots: Column) -> Column:
    return round_half_up(shots * P.GRAMS_PER_SHOT)


def described_shots(description: Column) -> Column:
    """Shot equivalents of the spirits a description names; null where it names none."""
    text = F.lower(F.coalesce(description, F.lit("")))
    spirits, liqueurs = F.regexp_count(text, F.lit(P.SPIRITS)), F.regexp_count(text, F.lit(P.LIQUEURS))
    base = F.when(spirits == 0, 0.0).when(spirits == 1, 1.0).when(spirits == 2, 1.5).when(spirits == 3, 2.0).otherwise(2.5)
    return F.when(spirits + liqueurs > 0, base + liqueurs * F.lit(0.3))


def pour_ounces(text: Column, kind: str) -> Column:
    """Stated ounces within believable bounds, else the vessel, else the usual pour."""
    low, high = (4, 32) if kind == "beer" else (2, 12)
    stated = F.regexp_extract(text, P.OUNCES, 1).try_cast("int")
    has = lambda p: text.rlike(edges(p))
    out = F.when(stated.between(low, high), stated)
    if kind == "beer":
        return (
            out.when(has(r"\bpint\b"), 16).when(has("half yard"), 18).when(has(r"\byard\b"), 36)
            .when(has("growler"), 64).when(has("flight"), 16).otherwise(12)
        )
    out = out.when(has("flight"), 8)
    if kind == "sake":
        out = out.when(has("carafe|bottle"), 12)
    return out.otherwise(5)


def refine_alcohol(wide: DataFrame) -> DataFrame:
    """Better grams for beverages that have some; only changed values are emitted."""
    beers, shots, liqueurs = (RuleTable(t, ("v",)) for t in (P.BEER_ABV, P.COCKTAIL_SHOTS, P.LIQUEUR_ABV))
    name, text = NAME(), both_text()
    desc = F.lower(F.coalesce("description", F.lit("")))
    likely = name.rlike(edges(P.WINE_NAME))
    wine = F.when(F.lit(False), 0)
    for i, (pattern, _) in enumerate(P.WINE_ABV, start=1):
        wine = wine.when(name.rlike(edges(pattern)) | (likely & desc.rlike(edges(pattern))), i)
    rows = bound(wide.where((F.col("category") == "beverage") & (F.col("alcohol_grams") > 0)),
                 _shots_no=shots.first(name), _beer_no=beers.first(F.regexp_replace(text, "ginger ale|root beer|birch beer", "")),
                 _liqueur_no=liqueurs.first(text), _wine_no=wine, _desc_shots=described_shots(F.col("description")),
                 _beer_pour=pour_ounces(text, "beer"), _pour=F.when(text.rlike(edges(P.SAKE)), pour_ounces(text, "sake")).otherwise(pour_ounces(text, "wine")))
    recipe = shots.output(F.col("_shots_no"), "v")
    better = (F.col("_desc_shots") > recipe) & (F.col("_desc_shots") <= recipe * F.lit(1.5))
    wine_abv = F.try_element_at(F.array(*(F.lit(v) for _, v in P.WINE_ABV)), F.col("_wine_no"))
    pour = F.col("_pour")
    irish, coffee = text.rlike("irish coffee"), text.rlike(edges(P.LIQUEUR_COFFEE))
    food = name.rlike(edges(P.FOOD_NOT_DRINK))
    method = (
        F.when(food, "food").when(F.col("_shots_no").isNotNull(), "cocktail_recipe").when(irish | coffee, "liqueur_coffee")
        .when(F.col("_beer_no").isNotNull(), "beer_brand_abv").when(F.col("_desc_shots") > 0, "cocktail_description_parse")
        .when(F.col("_wine_no").isNotNull(), "wine_varietal_abv")
    )
    grams = (
        F.when(food, 0).when(F.col("_shots_no").isNotNull(), grams_from_shots(F.when(better, F.col("_desc_shots")).otherwise(recipe)))
        .when(irish, grams_from_shots(F.lit(1.0)))
        .when(coffee, grams_from_volume(F.lit(1.5), F.coalesce(liqueurs.output(F.col("_liqueur_no"), "v"), F.lit(17.0))))
        .when(F.col("_beer_no").isNotNull(), grams_from_volume(F.col("_beer_pour"), beers.output(F.col("_beer_no"), "v")))
        .when(F.col("_desc_shots") > 0, grams_from_shots(F.col("_desc_shots")))
        .when(F.col("_wine_no").isNotNull(), grams_from_volume(pour, wine_abv))
    )
    out = bound(rows, method=method, after=grams).select("item_id", "nutrition_id", "method", F.col("alcohol_grams").alias("before"), "after")
    return out.where("after IS NOT NULL AND method <> 'food' AND after <> before")


# --- allergens ------------------------------------------------------------------------------------------

def tag_allergens(items: DataFrame, existing: DataFrame) -> DataFrame:
    """New (item, allergen) pairs; "contains" words win over "may contain" words."""
    text = F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), "category"))
    # Dozens of patterns a row: a small file is more work than one task should do.
    rows = spread(items.select("item_id", text.alias("_text")))
    t = F.col("_text")
    hits = []
    for allergen, contains, may, exclude in V.ALLERGENS:
        severity = F.when(t.rlike(edges(V.allergen_pattern(contains))), "contains")
        if may:
            severity = severity.when(t.rlike(edges(V.allergen_pattern(may))), "may_contain")
        if exclude:
            severity = F.when(~t.rlike(edges(exclude)), severity)
        hits.append(F.when(severity.isNotNull(), F.struct(F.lit(allergen).alias("allergen_type"), severity.alias("severity"))))
    tagged = rows.select("item_id", F.explode(present(*hits)).alias("a")).select("item_id", "a.*")
    return tagged.join(existing.select("item_id", "allergen_type"), ["item_id", "allergen_type"], "left_anti")


# --- validation of outside estimates -----------------------------------------------------------------------

# Accepted ranges of an estimate.
ESTIMATE_RANGES = {
    "calories": (20, 3000), "carbs": (0, 400), "fat": (0, 200), "protein": (0, 150), "sugar": (0, 200), "fiber": (0, 50), "sodium": (0, 5000),
}


def estimate_errors() -> Column:
    checks = []
    for c, (low, high) in ESTIMATE_RANGES.items():
        v = F.col(c)
        checks.append(F.when(v.isNull(), F.lit(f"{c} is not a valid number")).when((v < low) | (v > high), F.lit(f"{c} out of range")))
    checks += [F.when(F.col("sugar") > F.col("carbs"), "sugar > carbs"), F.when(F.col("fiber") > F.col("carbs"), "fiber > carbs")]
    return present(*checks)


def accept_estimates(estimates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted at confidence 40 with rounded values, rejected with reasons)."""
    checked = estimates.withColumn("errors", estimate_errors())
    accepted = checked.where("size(errors) = 0").drop("errors").withColumns(
        {c: round_half_up(F.col(c)) for c in ESTIMATE_RANGES} | {"confidence_score": F.lit(40), "source": F.lit("crowdsourced")}
    )
    return accepted, checked.where("size(errors) > 0")


def validated_estimates(estimates: DataFrame) -> DataFrame:
    """Valid estimates with calories snapped to the macros where they differ by more than 30%."""
    implied = energy_of()
    off = ratio(F.abs(F.col("calories") - implied), F.col("calories"))
    return estimates.where(F.size(estimate_errors()) == 0).withColumn(
        "calories", F.when(off > 0.3, round_half_up(implied)).otherwise(F.col("calories"))
    )
