"""Known profiles against literal rows."""

from pyspark.sql import functions as F

from trencher.operators import templates

SCHEMA = "item_id long, nutrition_id string, name string, category string, calories int, carbs int, fat int, protein int, sugar int, fiber int, sodium int, cholesterol int, confidence_score int"


def rows(spark, *given):
    return spark.createDataFrame([(i, f"n{i}", name, "entree", *macros, 1, 1, 1, 1, 60) for i, (name, *macros) in enumerate(given)], SCHEMA)


def test_only_all_four_values_make_a_profile(spark):
    wide = rows(spark, ("a", 297, 18, 16, 20), ("b", 297, 18, 16, 21), ("c", 297, 18, 16, None), ("d", 1400, 122, 59, 95), ("e", 297, 18, 16, 20))
    found = templates.with_profile(wide, templates.profiles(spark)).select("name", "profile").collect()
    assert {(r["name"], r["profile"]) for r in found} == {("a", "platter_297"), ("d", "entree_1400"), ("e", "platter_297")}


def test_first_kind_counts_and_unknown_kinds_stay(spark):
    wide = rows(spark, ("Fish Platter", 297, 18, 16, 20), ("Fish Soup", 297, 18, 16, 20), (None, 297, 18, 16, 20), ("Soup and Salad", 430, 6, 45, 1))
    found = templates.replaced_profiles(wide, templates.profiles(spark))
    after = {}
    for r in found.collect():
        after.setdefault(r["item_id"], {})[r["field"]] = r["after"]
    assert after == {
        0: {"calories": 800, "carbs": 70, "fat": 40, "protein": 40, "sugar": 3, "fiber": 2, "sodium": 1300, "cholesterol": 70, "confidence_score": 40},
        3: {"calories": 500, "carbs": 44, "fat": 23, "protein": 29, "sugar": 4, "fiber": 4, "sodium": 1100, "cholesterol": 40, "confidence_score": 40},
    }


def test_equal_profiles_and_empty_tables(spark):
    wide = rows(spark, ("a", 1, 2, 3, 4))
    known = templates.profiles(spark, [(1, 2, 3, 4, "y"), (1, 2, 3, 4, "x")])
    assert [r["profile"] for r in templates.with_profile(wide, known).collect()] == ["x"]
    assert templates.replaced_profiles(wide.where(F.lit(False)), known).count() == 0
