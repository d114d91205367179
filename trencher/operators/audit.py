"""Data-quality check suites.

A suite is a list of checks; each check is a condition over the wide row and the
finding it emits.  One projection builds the array of findings and one explode
flattens it, so a suite is a single pass without a shuffle.  The suites use
different denominators and null rules on purpose.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions import detect
from trencher.functions.numeric import energy_nulls_zero, energy_of, ratio, round_half_up, zero_if_null
from trencher.functions.rules import RuleTable, bound, present
from trencher.functions.text import edges
from trencher.functions.vocab import alcohol as A
from trencher.functions.vocab import foods

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
SEVERITY_RANK = {"CRITICAL": 0, "HIGH": 1, "ERROR": 1, "MEDIUM": 2, "WARNING": 2, "LOW": 3, "INFO": 4}


@dataclass(frozen=True)
class Check:
    name: str
    when: Column
    severity: str | Column
    field: str | None = None
    current: Column | None = None
    suggested: Column | None = None
    message: Column | None = None
    fixable: bool = False


def _text(c: Column | str | None) -> Column:
    if c is None:
        return F.lit(None).cast("string")
    return F.lit(c) if isinstance(c, str) else c.cast("string")


def run_checks(df: DataFrame, checks: Sequence[Check], keep: Sequence[str] = ("item_id", "name", "restaurant_name", "park_name", "nutrition_id")) -> DataFrame:
    """Findings: one row per (row, check that holds)."""
    hits = [
        F.when(
            c.when,
            F.struct(
                F.lit(c.name).alias("check_name"), _text(c.severity).alias("severity"), _text(c.field).alias("field"),
                _text(c.current).alias("current_value"), _text(c.suggested).alias("suggested_value"),
                _text(c.message).alias("message"), F.lit(c.fixable).alias("fixable"),
            ),
        )
        for c in checks
    ]
    return df.select(*keep, F.explode(present(*hits)).alias("f")).select(*keep, "f.*")


def _exceeds(a: str, b: str) -> Column:
    return F.col(a) > F.col(b)


# --- accuracy (with machine-applicable fixes) ---------------------------------------

def accuracy_checks() -> list[Check]:
    calories, carbs = F.col("calories"), F.col("carbs")
    checks = [
        Check("fiber_gt_carbs", _exceeds("fiber", "carbs"), HIGH, "fiber", F.col("fiber"), round_half_up(carbs * F.lit(0.1)),
              F.format_string("Fiber (%dg) exceeds carbs (%dg) — impossible", "fiber", "carbs"), True),
        Check("sugar_gt_carbs", _exceeds("sugar", "carbs"), HIGH, "sugar", F.col("sugar"), carbs,
              F.format_string("Sugar (%dg) exceeds carbs (%dg) — impossible", "sugar", "carbs"), True),
        Check("sodium_extreme", F.col("sodium") > 10000, HIGH, "sodium", F.col("sodium"), round_half_up(F.col("sodium") / 10),
              F.format_string("Sodium (%dmg) exceeds 10000mg — likely decimal place error", "sodium"), True),
    ]
    for field in ("calories", "carbs", "fat", "protein", "sugar", "fiber"):
        checks.append(Check("negative_value", F.col(field) < 0, HIGH, field, F.col(field), F.lit(0),
                            F.format_string(f"{field} is negative (%d) — invalid", field), True))
    checks.append(Check("calories_extreme", calories > 5000, HIGH, "calories", calories,
                        message=F.format_string("Calories (%d) exceeds maximum plausible value of 5000", "calories")))
    estimate = energy_of()
    gap = F.abs(calories - estimate)
    deviation = ratio(gap, estimate) * 100
    medium = F.when(detect.likely_beverage(), 30).otherwise(20)
    severity = F.when((deviation > 50) & (gap >= 50), HIGH).when((deviation > medium) & (gap >= 30), MEDIUM)
    checks += [
        Check("atwater_deviation", (calories > 0) & (estimate > 0) & severity.isNotNull() & ~detect.likely_alcoholic(),
              severity, "calories", calories, estimate,
              F.format_string("Atwater deviation %.1f%% (stated %d cal vs estimated %d cal)", deviation, calories, estimate)),
        Check("zero_fat_fried", (F.col("fat") == 0) & (F.col("is_fried") | F.lower("name").rlike(edges(detect.FRIED_PASTRY))), MEDIUM, "fat", F.lit(0),
              message=F.lit("Fat is 0g but item appears to be fried/pastry — likely missing data")),
        Check("zero_protein_meat", (F.col("protein") == 0) & F.lower("name").rlike(edges(detect.MEAT)), MEDIUM, "protein", F.lit(0),
              message=F.lit("Protein is 0g but item appears to contain meat — likely missing data")),
    ]
    return checks


def check_accuracy(wide: DataFrame) -> DataFrame:
    return run_checks(wide.where("nutrition_id IS NOT NULL"), accuracy_checks())


def accuracy_fixes(findings: DataFrame) -> DataFrame:
    """Fixes with ``check_no``, the place of their check among the accuracy checks."""
    names = list(dict.fromkeys(c.name for c in accuracy_checks()))
    return findings.where("fixable").select(
        "nutrition_id", "field", F.col("current_value").cast("int").alias("before"), F.col("suggested_value").cast("int").alias("after"),
        F.col("check_name").alias("reason"), F.array_position(F.array(*(F.lit(n) for n in names)), F.col("check_name")).cast("int").alias("check_no"),
    )


def accuracy_stats(wide: DataFrame, findings: DataFrame) -> DataFrame:
    """Checked / clean / flagged, per item: a union of two counts, no join back."""
    flagged = findings.select("item_id").distinct().agg(F.count(F.lit(1)).alias("flagged")).withColumn("k", F.lit(1))
    return wide.where("nutrition_id IS NOT NULL").agg(F.count(F.lit(1)).alias("checked")).withColumn("k", F.lit(1)).join(flagged, "k").select(
        "checked", (F.col("checked") - F.col("flagged")).alias("clean"), "flagged"
    )


# --- completeness, staleness, source health --------------------------------------------

MIN_RESTAURANTS = {"theme-park": 10, "district": 10, "cruise-ship": 5, "water-park": 2, "resort": 1, "other": 1}


def check_completeness(wide: DataFrame) -> DataFrame:
    """Park- and restaurant-level findings, grouped by name.

    Items collapse to one row per restaurant first; parks are then summed over
    those rows, so the distinct restaurant count costs nothing extra.
    """
    low = (F.col("confidence_score") < 30) & F.col("nutrition_id").isNotNull()
    places = wide.groupBy(
        F.coalesce("park_name", F.lit("Unknown Park")).alias("park"), F.coalesce("restaurant_name", F.lit("Unknown Restaurant")).alias("restaurant")
    ).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("calories").isNull() | (F.col("calories") == 0)).alias("no_calories"),
        F.count_if(low).alias("low"),
    )
    sparse = places.where("items < 3").select(
        "park", "restaurant", F.lit("sparse_restaurant").alias("check_name"), F.lit(MEDIUM).alias("severity"),
        F.col("items").cast("string").alias("current_value"),
    )
    parks = places.groupBy("park").agg(
        F.count(F.lit(1)).alias("restaurants"), F.sum("items").alias("items"), F.sum("no_calories").alias("no_calories"), F.sum("low").alias("low")
    )
    kind = detect.park_type(F.col("park"))
    least = F.try_element_at(F.create_map(*(F.lit(x) for p in MIN_RESTAURANTS.items() for x in p)), kind)
    pct = F.col("no_calories") / F.col("items") * 100
    rows = present(
        F.when(F.col("restaurants") < least, F.struct(F.lit("sparse_park").alias("check_name"), F.lit(HIGH).alias("severity"), F.col("restaurants").cast("string").alias("current_value"))),
        F.when(pct > 30, F.struct(F.lit("null_calorie_coverage").alias("check_name"), F.lit(HIGH).alias("severity"), F.format_string("%.1f%%", pct).alias("current_value"))),
        F.when(F.col("low") > 0, F.struct(F.lit("low_confidence").alias("check_name"), F.lit(MEDIUM).alias("severity"), F.col("low").cast("string").alias("current_value"))),
    )
    park_level = parks.select("park", F.lit("").alias("restaurant"), F.explode(rows).alias("f")).select("park", "restaurant", "f.*")
    return park_level.unionByName(sparse)


def check_stale(wide: DataFrame, below: int = 50, at_least: int = 10) -> DataFrame:
    """Parks with many low-confidence items, their average and three sample names."""
    from pyspark.sql import Window

    low = wide.where(F.col("confidence_score") < below).withColumn("park", F.coalesce("park_name", F.lit("Unknown Park")))
    stats = low.groupBy("park").agg(F.count(F.lit(1)).alias("items"), F.avg("confidence_score").alias("avg_confidence")).where(F.col("items") >= at_least)
    rank = F.row_number().over(Window.partitionBy("park").orderBy("item_id"))
    samples = low.withColumn("r", rank).where("r <= 3").groupBy("park").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ", ").alias("samples")
    )
    return stats.join(samples, "park").select(
        "park", F.lit("stale_data").alias("check_name"), F.lit(LOW).alias("severity"), "items",
        F.format_string("%.1f", "avg_confidence").alias("avg_confidence"), "samples",
    )


def check_sources(status: DataFrame) -> DataFrame:
    """``status``: name, status, note.  Every source that is not operational is a LOW finding."""
    return status.where(F.col("status") != "operational").select(
        F.col("name").alias("park"), F.lit("scraper_health").alias("check_name"), F.lit(LOW).alias("severity"),
        F.col("status").alias("current_value"), F.lit("operational").alias("suggested_value"),
        F.concat(F.lit("Scraper status: "), "status", F.lit(". "), "note").alias("message"),
    )


# --- full audit: internal consistency, plausibility, patterns ----------------------------------

def consistency_checks() -> list[Check]:
    """Needs ``food_types``.  Energy gap is relative to the stated calories."""
    calories, carbs, fat, protein, sodium = (F.col(c) for c in ("calories", "carbs", "fat", "protein", "sodium"))
    implied = energy_of()
    gap = F.abs(implied - calories)
    share = F.when(calories > 0, ratio(gap, calories)).otherwise(0.0)
    macros = (calories > 0) & fat.isNotNull() & carbs.isNotNull() & protein.isNotNull()
    pct = lambda grams, per: ratio(grams * per, calories) * 100
    meat = F.arrays_overlap("food_types", F.array(*(F.lit(t) for t in ("steak", "turkey_leg", "chicken", "ribs", "seafood", "pork"))))
    described = F.lower(F.coalesce("description", F.lit("")))
    return [
        Check("caloric-math", (share > 0.25) & (gap > 50), F.when(gap > 200, HIGH).otherwise(MEDIUM)),
        Check("macro-ratio-fried", macros & F.col("is_fried") & (pct(fat, 9) < 20) & (calories > 100), MEDIUM),
        Check("macro-ratio-dessert", macros & (F.col("category") == "dessert") & (pct(carbs, 4) < 30) & (calories > 100), LOW),
        Check("macro-ratio-protein", macros & meat & (pct(protein, 4) < 15) & (calories > 200), MEDIUM),
        Check("low-sodium-savory", F.col("category").isin("entree", "snack") & (sodium < 150) & (calories > 300) & ~described.contains("sweet"), MEDIUM),
        Check("high-sodium-dessert", (F.col("category") == "dessert") & (sodium > 1000) & (calories > 0) & ~F.lower("name").rlike("pretzel|salted caramel|sea salt|bacon"), HIGH),
        Check("extreme-sodium", (sodium > 3000) & (calories > 0), HIGH),
        Check("sugar-exceeds-carbs", _exceeds("sugar", "carbs"), HIGH),
        Check("fiber-exceeds-carbs", _exceeds("fiber", "carbs"), HIGH),
        Check("negative-values", (calories < 0) | F.coalesce(fat < 0, F.lit(False)) | F.coalesce(carbs < 0, F.lit(False)) | F.coalesce(protein < 0, F.lit(False)), HIGH),
        Check("implausibly-low-cal", (calories > 0) & (calories < 20) & (F.col("category") == "entree"), HIGH),
    ]


def check_consistency(wide: DataFrame) -> DataFrame:
    return run_checks(detect.with_food_types(wide.where("calories IS NOT NULL")), consistency_checks())


def check_plausibility(wide: DataFrame) -> DataFrame:
    """Calories against the range of the item's food types (first type out of range), and fixed benchmarks."""
    rows = detect.with_food_types(wide.where("calories IS NOT NULL AND calories <> 0"))
    ranges = F.create_map(*(x for t, (lo, hi) in foods.CALORIE_RANGES.items() for x in (F.lit(t), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))))
    calories, name = F.col("calories"), F.lower("name")
    low = lambda r: calories < r["lo"] * F.lit(0.7)
    high = lambda r: calories > r["hi"] * F.lit(1.3)
    known = F.filter(F.transform("food_types", lambda t: F.struct(t.alias("type"), F.try_element_at(ranges, t).alias("r"))), lambda s: s["r"].isNotNull())
    rows = rows.withColumn("hit", F.get(F.filter(known, lambda s: low(s["r"]) | high(s["r"])), 0))
    r = F.col("hit.r")
    return run_checks(rows, [
        Check("below-range", low(r), F.when(calories < r["lo"] * F.lit(0.5), HIGH).otherwise(MEDIUM), "calories", F.col("hit.type"), r["lo"]),
        Check("above-range", high(r) & ~low(r), F.when(calories > r["hi"] * F.lit(1.5), HIGH).otherwise(MEDIUM), "calories", F.col("hit.type"), r["hi"]),
        Check("benchmark-coffee", name.rlike("^(brewed |hot )?coffee$") & (calories > 80), HIGH),
        Check("benchmark-water", name.rlike("^(bottled |spring |sparkling )?water$") & (calories > 5), HIGH),
        Check("benchmark-edamame", name.rlike("^edamame$") & ((calories > 400) | (calories < 80)), MEDIUM),
        Check("benchmark-salad", name.rlike("^(side |garden |house )?salad$") & (calories > 500), MEDIUM),
        Check("benchmark-fruit", name.rlike("fresh fruit|fruit cup|fruit platter") & (calories > 400), MEDIUM),
    ])


def check_round_numbers(wide: DataFrame) -> DataFrame:
    positive = F.filter(F.array("calories", "carbs", "fat", "protein"), lambda v: v > 0)
    return run_checks(wide, [
        Check("round-numbers", (F.col("calories") > 50) & (F.size(positive) >= 3) & F.forall(positive, lambda v: v % 10 == 0), LOW)
    ])


# --- nutrition audit: ratio bands ----------------------------------------------------------------

def ratio_checks() -> list[Check]:
    """Nulls read as zero; the ratio is stated over implied calories."""
    calories, carbs, fat, protein, sugar, fiber, sodium = (
        zero_if_null(F.col(c)) for c in ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium")
    )
    implied = energy_nulls_zero()
    r = ratio(calories, implied)
    drink = detect.gap_aware_alcoholic() & (r > 1.0)
    small = (calories < 100) & (F.abs(calories - implied) < 50)
    extreme, off = (r < 0.5) | (r > 2.0), (r < 0.75) | (r > 1.35)
    pct = lambda grams, per: ratio(grams * per, calories) * 100
    name = F.lower("name")
    described = F.concat(name, F.lit(" "), F.lower(F.coalesce("description", F.lit(""))))
    grilled = r"turkey leg|chicken dinner|grilled (chicken|steak|salmon|fish)|ribeye|rib.eye|filet|tenderloin|pork chop"
    sweet_drink = r"fruit|smoothie|juice|tea\b|coffee|water|milk|açaí|acai"
    return [
        Check("caloric-math", (calories > 50) & (implied > 50) & (extreme | off),
              F.when(drink, LOW).when(extreme, HIGH).when(small, LOW).otherwise(MEDIUM)),
        Check("macro-ratio-fried", (calories > 100) & F.col("is_fried") & (fat > 0) & (pct(fat, 9) < 20), MEDIUM),
        Check("macro-ratio-dessert", (calories > 100) & (F.col("category") == "dessert") & (carbs > 0) & (pct(carbs, 4) < 30), LOW),
        Check("macro-ratio-protein", (calories > 100) & name.rlike(edges(grilled)) & (protein > 0) & (pct(protein, 4) < 15), MEDIUM),
        Check("sodium-savory", (calories > 200) & (F.col("category") == "entree") & (sodium > 0) & (sodium < 200)
              & ~name.rlike(edges(detect.DESSERT_LIKE)) & ~name.rlike(edges(sweet_drink)), LOW),
        Check("sodium-dessert", (calories > 200) & (F.col("category") == "dessert") & (sodium > 1500) & ~described.rlike("pretzel|salted|salt|caramel"), MEDIUM),
        Check("sugar-carbs", (sugar > carbs) & (carbs > 0), HIGH),
        Check("fiber-carbs", (fiber > carbs) & (carbs > 0), HIGH),
    ]


def check_ratios(wide: DataFrame) -> DataFrame:
    return run_checks(wide.where("nutrition_id IS NOT NULL"), ratio_checks())


PROFILE_TABLE = RuleTable(foods.PROFILES, foods.PROFILE_COLUMNS)


def check_profiles(wide: DataFrame) -> DataFrame:
    """First matching profile; calories off by a quarter is HIGH, other macros MEDIUM."""
    rows = bound(wide.where("calories <> 0"), profile_no=PROFILE_TABLE.first(F.lower("name"))).where("profile_no IS NOT NULL")
    rows = bound(rows, **{c: PROFILE_TABLE.output(F.col("profile_no"), c) for c in foods.PROFILE_COLUMNS})
    c = {k: zero_if_null(F.col(k)) for k in ("calories", "carbs", "fat", "protein")}
    energy_off = (c["calories"] < F.col("cal_lo") * F.lit(0.75)) | (c["calories"] > F.col("cal_hi") * F.lit(1.25))
    issues = present(*(
        F.when(test, F.lit(label))
        for label, test in (
            ("calories low", c["calories"] < F.col("cal_lo") * F.lit(0.75)), ("calories high", c["calories"] > F.col("cal_hi") * F.lit(1.25)),
            ("carbs low", (c["carbs"] > 0) & (c["carbs"] < F.col("carb_lo") * F.lit(0.6))), ("carbs high", c["carbs"] > F.col("carb_hi") * F.lit(1.4)),
            ("fat low", (c["fat"] > 0) & (c["fat"] < F.col("fat_lo") * F.lit(0.5))), ("fat high", c["fat"] > F.col("fat_hi") * F.lit(1.5)),
            ("protein low", (c["protein"] > 0) & (c["protein"] < F.col("protein_lo") * F.lit(0.5))), ("protein high", c["protein"] > F.col("protein_hi") * F.lit(1.5)),
        )
    ))
    return bound(rows, issues=issues).where("size(issues) > 0").select(
        "item_id", "label", F.array_join("issues", "; ").alias("issues"), F.when(energy_off, HIGH).otherwise(MEDIUM).alias("severity")
    )


WATER_NOT = r"watermelon|waterfront|cold water|water chestnut|waterfall|water park|coconut\s*water|vitamin\s*water|flavored.*water|premium\s*water|tulum|moon on the"


def check_water(wide: DataFrame) -> DataFrame:
    name = F.lower("name")
    return run_checks(wide, [
        Check("category-ranking", (F.col("category") == "beverage") & name.rlike(edges(r"\bwater\b")) & ~name.rlike(edges(WATER_NOT)) & (F.col("calories") > 20), MEDIUM, "calories", F.col("calories"))
    ])


# --- math audit ---------------------------------------------------------------------------------------

# Word lists of the math audit.
MATH_MEAT = r"\b(steak|sirloin|chicken|beef|pork|fish|salmon|shrimp|lobster|turkey|lamb|duck|ribs|brisket|burger)\b"
MATH_STARCH = r"\b(pasta|rice|noodle|sandwich|wrap|burger|pizza|flatbread|bread|bun|tortilla|taco|burrito|mac.?(?:and|&|n).?cheese|ramen|udon)\b"
MATH_DIET = r"\b(diet|zero|sugar.?free|unsweetened|water|sparkling|seltzer)\b"
MATH_SODA = r"\b(coca.?cola|pepsi|sprite|fanta|dr.?pepper|root.?beer|lemonade|sweet tea|juice|soda)\b"
MATH_FRIED = r"\b(fries|fried|onion rings|tater tots|chips|fritters|tempura)\b"


def math_checks() -> list[Check]:
    calories, carbs, fat, protein, sugar, fiber, sodium = (
        F.col(c) for c in ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium")
    )
    implied = energy_nulls_zero()
    deviation = ratio(F.abs(calories - implied), implied) * 100
    name, category = F.lower("name"), F.col("category")
    is_a = lambda c: category == c
    diet = name.rlike(edges(MATH_DIET))
    soda = is_a("beverage") & name.rlike(edges(MATH_SODA)) & ~diet
    sweet = is_a("dessert") & ~name.rlike("sugar.?free")
    fried_side = is_a("side") & (F.col("is_fried") | name.rlike(edges(MATH_FRIED))) & (calories > 0)
    core = sum((F.col(c).isNull().cast("int") for c in ("calories", "carbs", "protein", "fat")), F.lit(0))
    by_five = lambda *cs: [c % 5 == 0 for c in cs]
    round_values = (calories > 0) & (protein > 0) & (carbs > 0) & (fat > 0)
    for t in by_five(calories, protein, carbs, fat):
        round_values = round_values & t
    known = protein.isNotNull() & carbs.isNotNull() & fat.isNotNull()
    checks = [
        Check("atwater_calorie", (calories > 0) & (implied > 0) & (deviation > 10),
              F.when(deviation > 50, "CRITICAL").when(deviation > 20, "ERROR").otherwise("WARNING"), "calories", F.format_string("%.1f", deviation)),
        Check("atwater_zero_macros", (calories > 0) & (implied == 0), "CRITICAL", "calories"),
        Check("atwater_no_calories", (zero_if_null(calories) == 0) & (implied > 0), "CRITICAL", "calories"),
        Check("impossible_sugar_gt_carbs", sugar > carbs, "CRITICAL", "sugar"),
        Check("impossible_fiber_gt_carbs", fiber > carbs, "CRITICAL", "fiber"),
    ]
    for field in ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium", "cholesterol"):
        checks.append(Check("impossible_negative", F.col(field) < 0, "CRITICAL", field))
    checks += [
        Check("plausibility_entree_too_low", is_a("entree") & (calories > 0) & (calories < 100), "CRITICAL", "calories"),
        Check("plausibility_entree_too_high", is_a("entree") & (calories > 3000), "ERROR", "calories"),
        Check("plausibility_meat_low_protein", is_a("entree") & (protein < 5) & name.rlike(edges(MATH_MEAT)), "ERROR", "protein"),
        Check("plausibility_starch_zero_carbs", is_a("entree") & (carbs == 0) & name.rlike(edges(MATH_STARCH)), "ERROR", "carbs"),
        Check("plausibility_diet_drink_calories", is_a("beverage") & diet & (calories > 15), "WARNING", "calories"),
        Check("plausibility_soda_low_carbs", soda & (carbs < 15), "ERROR", "carbs"),
        Check("plausibility_soda_has_fat", soda & (fat > 3), "ERROR", "fat"),
        Check("plausibility_soda_has_protein", soda & (protein > 3), "ERROR", "protein"),
        Check("plausibility_dessert_too_low", is_a("dessert") & (calories > 0) & (calories < 50), "ERROR", "calories"),
        Check("plausibility_dessert_low_carbs", sweet & (carbs < 10), "ERROR", "carbs"),
        Check("plausibility_dessert_no_sugar", sweet & (sugar == 0), "ERROR", "sugar"),
        Check("plausibility_fried_low_fat", fried_side & (fat < 5), "ERROR", "fat"),
        Check("plausibility_fried_low_carbs", fried_side & (carbs < 10), "ERROR", "carbs"),
        Check("plausibility_extreme_sodium", sodium > 5000, "ERROR", "sodium"),
        Check("round_values", round_values, "INFO", "all_macros"),
        Check("exact_atwater", known & (calories == implied) & (calories > 50), "INFO", "calories"),
        Check("missing_core_fields", core > 0, F.when(core >= 3, "ERROR").otherwise("WARNING"), "core", core),
        Check("calories_only_no_macros", (calories > 0) & carbs.isNull() & protein.isNull() & fat.isNull(), "ERROR", "carbs,protein,fat"),
        Check("missing_important_fields", sodium.isNull() & fiber.isNull() & sugar.isNull(), "INFO", "sodium,fiber,sugar"),
        Check("no_nutrition_record", F.col("nutrition_id").isNull(), "ERROR", "all"),
    ]
    return checks


def check_math(wide: DataFrame) -> DataFrame:
    return run_checks(wide, math_checks())


# --- quality issues with a priority ------------------------------------------------------------------------

def quality_issues(wide: DataFrame) -> DataFrame:
    """Issue list per item and the priority its texts imply."""
    name, category = F.lower("name"), F.col("category")
    calories, carbs, fat, protein = (F.col(c) for c in ("calories", "carbs", "fat", "protein"))
    off = ratio(F.abs(calories - energy_of()), calories)
    low = [
        F.when((calories > 0) & name.contains(word) & (calories < bound), F.format_string(f"{word} only %d cal (expected >{bound})", calories))
        for word, bound in foods.TOO_LOW.items()
    ]
    plain = ~name.contains("platter") & ~name.contains("combo")
    high = [
        F.when((calories > bound) & ((category == word) | (name.contains(word) & plain)), F.format_string(f"{word} at %d cal (expected <{bound})", calories))
        for word, bound in foods.TOO_HIGH.items()
    ]
    issues = present(
        F.when((zero_if_null(calories) == 0) & ~name.rlike(edges(foods.ZERO_ENERGY_DRINKS)), "Missing calories"),
        F.when((calories != 0) & (off > 0.35) & ~name.rlike(edges(A.QUALITY_ALCOHOL)), F.format_string("Caloric math off by %d%%", round_half_up(off * 100))),
        F.when(_exceeds("sugar", "carbs"), "Sugar exceeds carbs"),
        F.when(_exceeds("fiber", "carbs"), "Fiber exceeds carbs"),
        *low, *high,
        F.when(F.col("is_fried") & (fat < 10), "Fried item has low fat"),
        F.when((category == "dessert") & F.col("sugar").isNull(), "Dessert missing sugar data"),
        *(F.when(F.col(c).isNull(), f"Missing {c}") for c in ("protein", "carbs", "fat", "sodium")),
        F.when(F.col("confidence_score") < 35, F.format_string("Low confidence: %d", "confidence_score")),
    )
    says = lambda *parts: F.exists("issues", lambda i: i.rlike(edges("|".join(parts))))
    return wide.where("nutrition_id IS NOT NULL").withColumn("issues", issues).where("size(issues) > 0").withColumn(
        "priority",
        F.when(says("Missing calories"), "critical").when(says("math off", "exceeds"), "high")
        .when(says("only", "Fried", "Dessert"), "medium").otherwise("low"),
    )


def real_issues(issues: DataFrame) -> DataFrame:
    """Post-filter that drops expected gaps (zero-calorie drinks, alcohol, coffee)."""
    name = F.lower("name")
    legit, expected = name.rlike(edges(foods.ZERO_ENERGY_NAMES)), name.rlike(edges(A.MISMATCH_EXPECTED))
    food = F.col("category").isin("entree", "dessert", "side", "snack")
    calories = F.col("calories")
    says = lambda text: F.exists("issues", lambda i: i.contains(text))
    only_expected = F.forall("issues", lambda i: i.contains("math off") | i.contains("Missing"))
    percent = F.regexp_extract(F.get(F.filter("issues", lambda i: i.contains("math off")), 0), r"(\d+)%", 1).try_cast("int")
    wanted = (
        (food & (calories < 50) & ~legit) | says("Sugar exceeds") | says("Fiber exceeds") | (says("only") & ~expected)
        | (calories.isNull() & food) | (says("math off") & ~expected & (percent >= 50))
    )
    return issues.where(~(legit & (zero_if_null(calories) == 0)) & ~(expected & only_expected) & F.coalesce(wanted, F.lit(False)))


def priority_order() -> list[Column]:
    rank = F.when(F.col("priority") == "critical", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return [rank.asc(), zero_if_null(F.col("calories")).asc(), F.col("item_id").asc()]


# --- hard constraints, low values, mismatch bands --------------------------------------------------------------

def constraint_violations(nutrition: DataFrame) -> DataFrame:
    """Adds ``violations``; rows with an empty array are valid, the rest go to quarantine."""
    between = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    rules = {
        "fiber_lte_carbs": _exceeds("fiber", "carbs"), "sugar_lte_carbs": _exceeds("sugar", "carbs"),
        "calories_range": between("calories", 0, 5000), "sodium_range": between("sodium", 0, 10000),
        "macros_non_negative": F.least("carbs", "fat", "protein", "sugar", "fiber") < 0,
        "confidence_range": between("confidence_score", 0, 100),
    }
    return nutrition.withColumn("violations", present(*(F.when(test, F.lit(n)) for n, test in rules.items())))


def split_valid(nutrition: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = constraint_violations(nutrition)
    return marked.where("size(violations) = 0").drop("violations"), marked.where("size(violations) > 0")


def check_low_values(wide: DataFrame) -> DataFrame:
    """Values too low for what the name promises."""
    name, calories, carbs = F.lower("name"), F.col("calories"), F.col("carbs")
    has = lambda *words: name.rlike(edges("|".join(words)))
    light = has("water", "diet", "espresso") | (has("coffee") & ~has("frappe") & ~has("latte")) | (has("tea") & ~has("sweet"))
    implied = energy_of()
    pizza = has("pizza") | ((F.col("category") == "entree") & F.lower(F.coalesce("description", F.lit(""))).contains("pizza"))
    return run_checks(wide.where((F.col("calories") != 0) & ~light), [
        Check("BUN_LOW_CARBS", has("burger", "sandwich", "hot dog", "wrap", "sub", "hoagie") & (carbs < 25) & (calories > 100), MEDIUM),
        Check("HOTDOG_LOW_CAL", has("hot dog") & (calories < 300) & (calories > 50), MEDIUM),
        Check("CHILI_LOW_CAL", has("chili") & ~has("sauce", "oil") & (calories < 200) & (calories > 50), MEDIUM),
        Check("BURGER_LOW_CAL", has("burger") & ~has("veggie", "impossible") & (calories < 400) & (calories > 100), MEDIUM),
        Check("PIZZA_LOW_CAL", pizza & ~has("bread") & (calories < 250) & (calories > 50), MEDIUM),
        Check("MACRO_MATH", (carbs != 0) & (ratio(implied, calories) > 2.5) & (calories > 50) & (calories < 400), MEDIUM),
    ])


def undercounted(wide: DataFrame) -> DataFrame:
    """Listing of entrées under 200 and of foods whose macros imply twice the stated calories."""
    name = F.lower("name")
    entree = (F.col("category") == "entree") & (F.col("calories") > 0) & (F.col("calories") < 200) & ~name.rlike("salad|soup|water|coffee|tea")
    macro = (
        (F.col("category") != "beverage") & (F.col("calories") > 0) & (F.col("calories") < 300) & (F.col("carbs") > 0)
        & (F.col("protein") >= 0) & (F.col("fat") >= 0) & (ratio(energy_of(), F.col("calories")) > 2.0)
    )
    return run_checks(wide, [Check("entree_under_200", entree, LOW), Check("macros_twice_stated", macro, LOW)])


MISMATCH_NOT = r"beer|wine|margarita|cocktail|sangria|ale|lager|ipa|old fashioned|mai tai|rum|vodka|whiskey|tequila|butterbeer|wizard.*brew|mojito|daiquiri|spritz|bellini|mimosa|prosecco|champagne|aperol|negroni|bourbon|gin|scotch"


def mismatch_bands(wide: DataFrame) -> DataFrame:
    """HIGH energy mismatches that no alcohol explains, by size."""
    high = check_ratios(wide).where("check_name = 'caloric-math' AND severity = 'HIGH'").select("item_id")
    implied = energy_nulls_zero()
    r = ratio(zero_if_null(F.col("calories")), implied)
    band = F.when(r > 2.5, "extreme_over").when(r < 0.5, "extreme_under").otherwise("moderate")
    return wide.join(high, "item_id", "left_semi").where(~F.lower("name").rlike(edges(MISMATCH_NOT))).select(
        "item_id", band.alias("band"), (zero_if_null(F.col("calories")) - implied).alias("gap")
    )


# --- findings: union, dedupe, tallies, ordering, display caps ---------------------------------------------------------

def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_per_issue(findings: DataFrame, keys: Sequence[str] = ("name", "check_name"), order: str = "item_id") -> DataFrame:
    """First finding per key, by ``min_by`` so a hot key combines before the shuffle."""
    rest = [c for c in findings.columns if c not in keys]
    return findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("f")).select(*keys, "f.*")


def tally(findings: DataFrame, by: str = "check_name") -> DataFrame:
    levels = ["CRITICAL", "ERROR", "HIGH", "MEDIUM", "WARNING", "LOW", "INFO"]
    return findings.groupBy(by).pivot("severity", levels).count().na.fill(0)


def severity_order(column: str = "severity") -> Column:
    ranks = F.create_map(*(F.lit(x) for p in SEVERITY_RANK.items() for x in p))
    return F.try_element_at(ranks, F.col(column)).asc_nulls_last()


def report_rows(findings: DataFrame, per_group: int = 10, group: str = "park_name", order: str = "item_id") -> DataFrame:
    """First rows of every group for display, each with how many more there are."""
    from pyspark.sql import Window

    totals = findings.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy(group).orderBy(severity_order(), order, "check_name", F.coalesce("field", F.lit("")))
    shown = findings.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_group)
    return shown.join(totals, shown[group].eqNullSafe(totals[group])).select(
        shown["*"], F.greatest(F.lit(0), F.col("total") - per_group).alias("more")
    )
