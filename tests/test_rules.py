"""Small frames with literal expectations."""

import pytest
from pyspark.sql import functions as F

from trencher.functions import text
from trencher.operators import audit, fixes


@pytest.mark.parametrize("given, key", [
    ("\U0001d400lpha", "alpha"),
    ("&#0000000000000000000000065;bc", "abc"),
    ("&#x000000000000000000000000041;bc", "abc"),
    ("Mickey’s Fries", "mickey fries"),
    ("Universals Cafe", "universal cafe"),
    ("café", "cafe"),
])
def test_canonical_key(spark, given, key):
    row = spark.createDataFrame([(given,)], "name string").select(text.canonical_key(F.col("name")).alias("k")).first()
    assert row["k"] == key


def test_entities_beyond_unicode_stay(spark):
    row = spark.createDataFrame([("&#99999999999999999999999;x",)], "name string").select(text.decode_entities(F.col("name")).alias("k")).first()
    assert row["k"] == "&#99999999999999999999999;x"


def test_last_check_wins(spark):
    findings = spark.createDataFrame(
        [(1, "sugar", -2, -5, "sugar_gt_carbs", True), (1, "sugar", -2, 0, "negative_value", True), (1, "carbs", -5, 0, "negative_value", True)],
        "nutrition_id long, field string, current_value int, suggested_value int, check_name string, fixable boolean")
    row = fixes.batch(audit.accuracy_fixes(findings)).first()
    assert row["updates"] == {"sugar": 0, "carbs": 0} and row["n_fixes"] == 3


def test_a_batch_can_null_a_field(spark):
    table = spark.createDataFrame([(1, 10, 3), (2, 20, 4)], "nutrition_id long, calories int, fat int")
    batch = spark.sql("SELECT 1L AS nutrition_id, map('calories', CAST(NULL AS INT)) AS updates")
    out = {r["nutrition_id"]: (r["calories"], r["fat"]) for r in fixes.apply_batch(table, batch, fields=("calories", "fat")).collect()}
    assert out == {1: (None, 3), 2: (20, 4)}


def test_graduation(spark):
    from trencher.operators import daily

    def modes(days):
        rows = [("d", i, *day) for i, day in enumerate(days)]
        found = daily.graduation(spark.createDataFrame(rows, "dataset string, day int, high long, medium long, low long, auto_fixes long")).orderBy("day").collect()
        return [(r["clean_days"], r["mode"]) for r in found]

    clean, low, fixed, high = (0, 0, 0, 0), (0, 0, 9, 0), (0, 0, 0, 1), (1, 0, 0, 0)
    assert modes([clean] * 13)[-1] == (13, "daily") and modes([clean] * 13 + [low])[-1] == (14, "weekly")
    assert modes([clean] * 20 + [fixed])[-1] == (0, "weekly") and modes([clean] * 20 + [high])[-1] == (0, "daily")
    assert modes([clean] * 20 + [fixed, clean, high, clean])[-1] == (1, "daily")


def test_recent_history(spark):
    from trencher.operators import daily

    days = spark.createDataFrame([("d", i) for i in range(31)], "dataset string, day int")
    assert sorted(r["day"] for r in daily.recent(days).collect()) == list(range(1, 31))


def test_fuzzy_search(spark):
    from trencher.operators import search

    items = [(1, "Turkey Leg", "Smokehouse", None), (2, "DOLE Whip", "Aloha Isle", ""), (3, "Grilled Chicken Sandwich", None, "Flame-grilled chicken"), (4, None, None, None)]
    wide = spark.createDataFrame(items, "item_id long, name string, restaurant_name string, description string")
    asked = ["Turkey Leg", "turky leg", "dole wip", "Aloha Isle", "flame-grilled", "", "   ", "xyzzynonexistent"]
    best = {}
    for r in search.fuzzy_hits(wide, asked).collect():
        best[r["query"]] = min(best.get(r["query"], (9999, 0)), (r["relevance"], r["item_id"]))
    assert {q: i for q, (_, i) in best.items()} == {"turkey leg": 1, "turky leg": 1, "dole wip": 2, "aloha isle": 2, "flame-grilled": 3}
    assert search.fuzzy_hits(wide, ["a"]).count() == 0


def test_meal_totals(spark):
    from trencher.operators import meals

    rows = [(1, 10, 95, 800, 38, 6, 72, 1, None, None, True), (1, 11, None, None, None, None, None, None, None, 69, False), (2, 10, 0, 0, 0, 0, 0, 0, 0, 70, True)]
    given = spark.createDataFrame(rows, "meal_id long, item_id long, carbs int, calories int, fat int, protein int, sugar int, fiber int, sodium int, confidence_score int, available boolean")
    found = {r["meal_id"]: r for r in meals.meal_totals(given).collect()}
    assert (found[1]["carbs"], found[1]["sodium"], found[1]["low_confidence_count"], found[1]["unavailable_count"]) == (95, 0, 1, 1)
    assert found[1]["grade"] == "F" and found[2]["score"] == 100
    assert {tuple(r) for r in meals.meal_warnings(given).collect()} == {(1, 11, "low_confidence"), (1, 11, "unavailable")}


def test_merge_sources(spark):
    from trencher.operators import merge

    rows = [(1, "yelp", "EPCOT", "Grill", None, "Turkey-Leg!", None, 10.0, "snack"), (2, "official", "Epcot", "grill ", "Main", "turkeyleg", "big", 11.6, None),
            (3, "dfb", "EPCOT", "Grill", None, "Water", None, 10.0, None), (4, "dfb", "EPCOT", "Grill", None, "Water", "later", 11.5, None),
            (5, "blog", None, None, None, None, None, None, None), (6, "yelp", "EPCOT", "Grill", None, "Cake", None, 0.0, None), (7, "blog", "EPCOT", "Grill", None, "Cake", None, 5.0, None)]
    given = spark.createDataFrame(rows, "at int, source string, park_name string, restaurant_name string, land string, name string, description string, price double, category string")
    found = {r["name_key"]: r for r in merge.merge_sources(given, ["at"]).collect()}
    leg, water, cake, none = (found[k] for k in ("turkeyleg", "water", "cake", ""))
    assert (leg["park_name"], leg["price"], leg["confidence"], leg["sources"], leg["price_conflict"], leg["category"]) == ("Epcot", 11.6, 100, ["official", "yelp"], True, "entree")
    assert (water["description"], water["price_conflict"], water["n_prices"]) == (None, False, 2)
    assert (cake["n_prices"], cake["price_conflict"], cake["confidence"]) == (1, False, 40) and none["confidence"] == 50


def test_dose_scores(spark):
    from trencher.functions.dosing import score_doses

    rows = [(1, 60.0, 180.0, 120.0, 10.0, 50.0, "none", None, None), (2, 60.0, 180.0, 120.0, 10.0, 50.0, "high", 2.0, None), (3, 60.0, 65.0, 120.0, 10.0, 50.0, "none", None, None),
            (4, None, 180.0, 120.0, 10.0, 50.0, "none", None, None), (5, 60.0, 180.0, 120.0, 2.0, 50.0, "none", None, None), (6, 250.0, 300.0, 100.0, 5.0, 20.0, "none", 0.0, 25.0)]
    given = spark.createDataFrame(rows, "k int, carbs double, blood_glucose double, target double, icr double, cf double, activity string, active_insulin double, max_bolus double")
    found = {r["k"]: r for r in score_doses(given.withColumn("blocked_by_nutrition", F.lit(False))).collect()}
    assert [found[k]["validation"] for k in range(1, 7)] == ["valid", "valid", "hypoglycemia", "incomplete", "invalid", "valid"]
    assert (found[1]["suggested"], found[1]["correction"]) == (7.2, 1.2) and (found[2]["suggested"], found[2]["correction_after_iob"]) == (3.0, 0.0)
    assert found[2]["triggers"] == ["IOB exceeds correction need: correction insulin is reduced to 0 units."]
    assert found[3]["low_glucose"] and not found[3]["urgent_low"] and found[3]["suggested"] is None
    assert found[6]["dose_status"] == "blocked" and found[6]["suggested"] is None and found[4]["messages"] == ["Enter total carbs."]
