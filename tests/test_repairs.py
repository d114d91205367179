"""Repairs in phases and better choices, on literal rows."""

from pyspark.sql import functions as F

from trencher.operators import fixes, repairs

WIDE = ("item_id long, nutrition_id string, name string, description string, category string, source string, confidence_score int, "
        "calories int, carbs int, fat int, protein int, sugar int, fiber int, sodium int")


def fixed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["nutrition_id"], {})[r["field"]] = r["after"]
    return out


def wide(spark, **rows):
    full = [(i, k, v.get("name"), v.get("description"), v.get("category", "entree"), v.get("source", "api_lookup"), v.get("confidence"),
             *[v.get(c) for c in ("calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium")]) for i, (k, v) in enumerate(rows.items())]
    return spark.createDataFrame(full, WIDE)


def test_first_case_counts(spark):
    found = fixed(repairs.calorie_mismatch(wide(
        spark, low=dict(name="Half chicken", calories=90, carbs=100, fat=50, protein=1), coffee=dict(name="Coffee", calories=60, protein=21, confidence=20), milky=dict(name="Coffee", description="with cream", calories=60, protein=21),
        chicken=dict(name="HALF CHICKEN", calories=500, carbs=10, fat=0, protein=3, confidence=30), dry=dict(name="Fried pork", calories=500, carbs=50, fat=None, protein=20), fine=dict(name="Soup", calories=300, carbs=40, fat=10, protein=10))))
    assert found == {"low": {"calories": 854, "confidence_score": 40}, "coffee": {"calories": 5, "carbs": 0, "sugar": 0, "fiber": 0, "fat": 0, "protein": 0, "confidence_score": 80},
                     "chicken": {"protein": 31, "confidence_score": 30}, "dry": {"fat": 24, "confidence_score": 40}}


def test_extremes(spark):
    found = fixed(repairs.extreme_values(wide(
        spark, carbs=dict(name="Cake", calories=900, carbs=300, sugar=200), all_=dict(name="Taco", calories=4001, carbs=41, fat=11, protein=5, sugar=41, fiber=60, sodium=99), none=dict(name="Taco", carbs=30, sugar=30))))
    assert found == {"carbs": {"carbs": 101, "sugar": 56, "confidence_score": 40},
                     "all_": {"calories": 2001, "carbs": 21, "fat": 6, "protein": 3, "sugar": 4, "fiber": 15, "sodium": 50, "confidence_score": 40}}


def test_the_first_phase_keeps_a_record(spark):
    given = wide(spark, both=dict(name="Pie", calories=500, carbs=300, fat=10, protein=10, sugar=290), late=dict(name="Pie", category="beverage", calories=500, carbs=300, fat=10, protein=10))
    phases = [repairs.inflated_macros(given), repairs.calorie_mismatch(given), repairs.extreme_values(given)]
    assert {k for p in (phases[0], phases[2]) for k in fixed(p)} == {"both", "late"}
    kept = fixes.phased(*phases)
    assert {(r["nutrition_id"], r["phase"]) for r in kept.collect()} == {("both", 1), ("late", 3)}
    table = given.select("nutrition_id", "calories", "carbs", "fat", "protein", "sugar", "confidence_score")
    after = {r["nutrition_id"]: r for r in fixes.apply_batch(table, fixes.batch(kept.withColumn("check_no", F.col("phase")))).collect()}
    assert tuple(after["both"])[1:] == (500, 113, 4, 4, 34, 40) and tuple(after["late"])[1:3] == (500, 56)


def test_better_choices(spark):
    scored = spark.createDataFrame([(1, 1, 90), (2, 1, 90), (3, 1, 90), (4, 1, 50), (5, 1, None), (6, 2, 10), (7, 2, 99), (8, None, 1)], "item_id long, restaurant_id long, score int")
    found = sorted(tuple(r) for r in repairs.better_choices(scored).collect())
    assert found == [(4, 1, 1, 90), (4, 2, 2, 90), (6, 1, 7, 99)]
