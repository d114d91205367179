"""Lookup of reference foods on literal rows."""

from trencher.operators import reference

ITEM = "item_id long, nutrition_id string, name string, description string, calories int, carbs int, fat int, sugar int, protein int, fiber int, sodium int, cholesterol int"
FOOD = "food_id long, food_name string, calories int, carbs int, fat int, sugar int, protein int, fiber int, sodium int, cholesterol int"


def test_steps_gaps_and_confidence(spark):
    foods = spark.createDataFrame([
        (1, "Cake", 100, 10, 5, 7, 3, None, 9, 1), (2, " cake ", 500, 1, 1, 1, 1, 1, 1, 1), (3, "pie", 0, 1, 1, 1, 1, 1, 1, 1), (4, "Pie", 200, 20, 2, 2, 2, 2, 2, 2),
        (5, "a plum", 300, None, 3, 3, 3, 3, 3, 3), (6, None, 1, 1, 1, 1, 1, 1, 1, 1), (7, "Famous tea", None, 1, 1, 1, 1, 1, 1, 1)], FOOD)
    items = spark.createDataFrame([
        (1, "n", "CAKE", "a plum", 110, 0, None, None, 1, 5, 1, 8),       # by name; the food's null fiber is written
        (2, "n", "Famous  Disney Pie", None, 0, 4, 0, 1, 1, 1, 1, 1),     # simplified; no calories yet
        (3, "n", "Famous tea", "A Plum", 700, None, 1, None, 1, 1, 1, 1), # its own food has no calories, the simplified name none at all
        (4, "n", "cake", "", 10, 1, 1, 1, 1, 1, 1, 1),                    # nothing missing
        (5, None, "cake", "", None, None, None, None, None, None, None, None),
        (6, "n", "stew", "", None, 1, 1, None, 1, 1, 1, 1),               # found nowhere
        (7, "n", None, "a plum", 450, 1, 1, None, 1, 1, 1, 1),
    ], ITEM)
    found = {r["item_id"]: tuple(r)[1:] for r in reference.looked_up(items, foods).collect()}
    assert found == {
        1: ("name", 1, 110, 10, 5, 7, 3, None, 9, 1, 85),
        2: ("simplified", 4, 200, 4, 2, 2, 2, 2, 2, 2, 50),
        3: ("description", 5, 700, None, 1, 3, 3, 3, 3, 3, 40),
        7: ("description", 5, 450, 1, 1, 3, 3, 3, 3, 3, 60),
    }
    assert reference.looked_up(items.limit(0), foods).count() == 0 == reference.looked_up(items, foods.limit(0)).count()
