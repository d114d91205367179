"""Matchers against comparing all pairs, and one-to-one assignment against taking turns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_FOLDER
from trencher.operators import imports, matching, resolve
from trencher.operators.storage import stored
from trencher.plans.catalogue import Catalogue

NAMES = "block string, name string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def similarity(a, b):
    return 1.0 if a == b else 1 - levenshtein(a, b) / max(len(a), len(b))


def score(a, b):
    if a == b:
        return 100
    if a in b or b in a:
        return math.floor(min(len(a), len(b)) / max(len(a), len(b)) * 90)
    x, y = set(a.split(" ")), set(b.split(" "))
    return math.floor(len(x & y) / len(x | y) * 80)


def names(seed, n):
    """Names of 0 to 12 words and near variants of them, in two blocks."""
    rng = random.Random(seed)
    vocabulary = ["a", "of", "big", "cheese", "burger", "grilled", "chicken", "sandwich", "pie", "apple", "with", "fries", "xl", "lagoon", "cafe", "hot"]
    out = [("one", ""), ("two", ""), ("one", "a"), (None, "a"), ("one", None)]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 8, 12]))
        for _ in range(2):
            own = list(words)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice([[], [own[at], "extra"], [own[at] + "s"], [own[at][1:]], own[at:at + 1] * 2])
                own = own or ["left"]
            if rng.random() < 0.2:
                rng.shuffle(own)
            out.append((rng.choice(["one", "two"]), " ".join(w for w in own if w)))
    return out


@pytest.fixture(scope="module")
def both(spark):
    left, right = names(1, 40), names(1, 40)[::2] + names(2, 20)
    return left, right, spark.createDataFrame(left, NAMES), spark.createDataFrame(right, NAMES)


def pairs(left, right, test):
    return {(b, x, y) for b, x in left for c, y in right if b is not None and b == c and x is not None and y is not None and test(x, y)}


@pytest.mark.parametrize("floor", [70, 75, 81, 50])
def test_fuzzy_pairs_lose_none(both, floor):
    left, right, a, b = both
    found = {tuple(r)[:3]: r["score"] for r in matching.fuzzy_pairs(a, b, floor).collect()}
    assert found.keys() == pairs(left, right, lambda x, y: score(x, y) >= floor)
    assert all(s == score(x, y) for (_, x, y), s in found.items()) and (floor > 80 or any(s < 100 for s in found.values()))


@pytest.mark.parametrize("above", [0.7, 0.75, 0.85])
def test_edit_pairs_lose_none(both, above):
    left, right, a, b = both
    found = {tuple(r)[:3] for r in matching.edit_pairs(a, b, above).collect()}
    assert found == pairs(left, right, lambda x, y: similarity(x, y) > above) and any(x != y for _, x, y in found)


def test_contained_pairs_lose_none(both, spark):
    left, right, a, b = both
    found = {tuple(r)[:3] for r in matching.contained_pairs(a, b).collect()}
    assert found == pairs(left, right, lambda x, y: x in y or y in x)


def long_names(seed):
    """Names around ``GRAM`` and ``LONG`` characters and parts of them from everywhere."""
    rng = random.Random(seed)
    whole = ["".join(rng.choices("ab c", k=n)) for n in (3, 63, 64, 65, 255, 256, 257, 300, 700)]
    parts = [n[at:at + m] for n in whole for m in (1, 62, 63, 64, 65, 200, 256, 257, 290) if m <= len(n) for at in (0, rng.randrange(len(n) - m + 1), len(n) - m)]
    return whole + parts[::2], whole + parts[1::2]


def test_contained_pairs_lose_no_long_names(spark):
    left, right = long_names(3)
    given = lambda names: spark.createDataFrame([("p", n) for n in names], NAMES)
    found = {tuple(r)[1:3] for r in matching.contained_pairs(given(left), given(right)).collect()}
    assert found == {(x, y) for x in left for y in right if x in y or y in x}
    assert any(len(x) > matching.LONG and matching.GRAM <= len(y) < len(x) for x, y in found) and any(len(y) > matching.LONG and matching.GRAM <= len(x) < len(y) for x, y in found)


def test_a_long_restaurant_name_holds_the_one_asked_for(spark):
    short = "pecos bill tall tale inn and cafe by the rivers of america on the frontier"
    wide = spark.createDataFrame([(1, 5, f"{short} {'far west ' * 40}", "Park", "Turkey Leg", None, None)],
                                 "item_id long, restaurant_id long, restaurant_name string, park_name string, name string, description string, photo_url string")
    dish = spark.createDataFrame([(1, "Park", short, "Turkey Leg", "big", None)], "dish_id long, park string, restaurant string, name string, description string, photo_url string")
    assert [tuple(r) for r in resolve.enrich_from_menus(dish, wide).collect()] == [(1, 1, 1.0, "restaurant", True, False)]


def test_park_names(spark):
    left = spark.createDataFrame([("MAGIC",), ("",), ("Kingdom",), ("kingdoms",)], "name string")
    right = spark.createDataFrame([(1, "Magic Kingdom"), (2, "Animal Kingdom")], "id long, name string")
    found = sorted(tuple(r) for r in matching.within(left, right).collect())
    assert found == [("", 1), ("", 2), ("kingdom", 1), ("kingdom", 2), ("magic", 1)]


def test_long_names_hold_those_asked_for(spark):
    left, right = long_names(4)
    known = [(i, x) for i, x in enumerate([*right, right[-1]])]
    found = sorted(tuple(r) for r in matching.within(spark.createDataFrame([(n,) for n in left], "name string"), spark.createDataFrame(known, "id long, name string")).collect())
    assert found == sorted((x, i) for x in set(left) for i, y in known if x in y)


def test_assignment_equals_taking_turns(spark):
    rng = random.Random(7)
    wishes = {w: rng.sample(range(25), rng.randrange(1, 12)) for w in range(8)}
    asking = [(p, rng.randrange(9)) for p in range(40)]
    taken, want = set(), {}
    for p, w in asking:
        for c in wishes.get(w, []):
            if c not in taken:
                taken.add(c)
                want[p] = c
                break
    found = resolve.assign_in_order(spark.createDataFrame(asking, "asker long, wish long"),
                                    spark.createDataFrame([(w, n, c) for w, own in wishes.items() for n, c in enumerate(own, 1)], "wish long, at int, choice long"))
    assert dict(found.collect()) == want


def test_contested_photos(spark):
    items = spark.createDataFrame([(1, "p", "Grilled Chicken Sandwich"), (2, "p", "Grilled Chicken"), (3, "q", "Grilled Chicken"), (4, "p", "Big Grilled Chicken Sandwich Deluxe")], "item_id long, park string, name string")
    keywords = ["grilled", "chicken", "pie"]
    photos = spark.createDataFrame([(10, "p", keywords), (11, "p", keywords), (12, "p", [*keywords, "sandwich", "deluxe"]), (13, "p", ["grilled", "grilled"]), (14, "p", ["pie"]), (15, None, keywords), (16, "p", None)],
                                   "photo_id long, park string, keywords array<string>")
    found = {r["photo_id"]: (r["item_id"], round(r["score"], 6)) for r in resolve.match_photos(photos, items).collect()}
    # 10 takes the best, 11 the next best, 12 what is left; a repeated keyword counts as often as it is given.
    assert found == {10: (2, round(2 / 2 ** 0.5, 6)), 11: (1, round(2 / 3 ** 0.5, 6)), 12: (4, round(4 / 5 ** 0.5, 6))}


def test_two_stages(spark):
    wide = spark.createDataFrame([(1, 5, "Pecos Bill", "Park", "Turkey Leg", None, None), (2, 6, "Sleepy Hollow", "Park", "Funnel Cake", "", None), (3, 6, "Sleepy Hollow", "Park", "Turkey Legs", None, None)],
                                 "item_id long, restaurant_id long, restaurant_name string, park_name string, name string, description string, photo_url string")
    rows = [(1, "Park", "Pecos Bil", "turkey legs", "big", None), (2, "Park", "Sleepy Hollow Inn", "Funel Cake", "crisp", "u"), (3, "Park", "Hollow", "Funnel Cake", "later", "v"),
            (4, "Park", "Nowhere", "Funnel Cake", "x", "y"), (5, "Park", "Pecos Bill", "Soup", "x", None), (6, "Park", "Pecos Bill", "Turkey Leg", "", None)]
    found = {r["dish_id"]: tuple(r)[1:] for r in resolve.enrich_from_menus(spark.createDataFrame(rows, "dish_id long, park string, restaurant string, name string, description string, photo_url string"), wide).collect()}
    assert found == {1: (1, 1 - 1 / 11, "restaurant", True, False), 2: (2, 1 - 1 / 11, "restaurant", True, True), 3: (2, 1.0, "restaurant", False, False), 5: (None, None, None, False, False)}


def test_few_neighbours_go_to_the_manual_list(spark):
    kind = "item_id long, name string, category string, calories int, carbs int, fat int, protein int, sugar int, fiber int, sodium int"
    existing = spark.createDataFrame([(1, "Grilled Chicken", "entree", 400, 10, 20, 30, 1, 2, 3), (2, "Grilled Chicken Salad", "side", 300, None, 10, 20, None, 2, 3), (3, "Grilled Chicken Wrap", "entree", 0, 9, 9, 9, 9, 9, 9),
                                      (4, "Chocolate Malt", None, 900, 90, 9, 9, 9, 9, 9)], kind)
    new = spark.createDataFrame([(7, "grilled CHICKEN", "entree"), (8, "Chicken Grilled Zesty", None), (9, "Mystery", "entree"), (10, None, None), (11, "", "entree")], "item_id long, name string, category string")
    found = {r["item_id"]: tuple(r)[1:] for r in resolve.estimate_by_neighbours(new, existing).collect()}
    # Both others share half or more with item 7: weights 100 and 66.
    assert found[7] == (360, 6, 16, 26, None, 2, 3, 80, 2, False)
    assert found[8][7:] == (53, 2, False) and found[9] == found[10] == found[11] == (None,) * 8 + (0, True)


@pytest.mark.parametrize("loose", [False, True])
def test_a_second_import_adds_nothing(spark, loose):
    parks = spark.createDataFrame([(1, "Magic Kingdom")], "park_id long, park_name string")
    restaurants = spark.createDataFrame([(1, 1, "Grill", None)], "restaurant_id long, park_id long, restaurant_name string, land string")
    items = spark.createDataFrame([(1, 1, "Taco", None)], "item_id long, restaurant_id long, name string, description string")
    rows = spark.createDataFrame([(1, "Magic Kingdom", "Grill", "Taco", None, None), (2, "magic", "GRILL", "taco!", None, None), (3, "Sea World", "Bar", "Fish", "East", "d"), (4, "sea", "bar", "fish", None, None),
                                  (5, "Sea World", "Bar", "Fish", None, None), (6, "Magic Kingdom", "Grill", "Soup", None, None), (7, None, "Bar", "Fish", None, None)],
                                 "row_id long, park string, restaurant string, name string, land string, description string")
    first = imports.import_menus(rows, parks, restaurants, items, loose)
    verdicts = {r["row_id"]: r["verdict"] for r in first.collect()}
    new = "duplicate" if loose else "imported"
    assert verdicts == {1: "duplicate", 2: new, 3: "imported", 4: new, 5: "duplicate", 6: "imported", 7: "incomplete"}
    made = imports.inserts(rows, first)
    assert sorted(r["park_name"] for r in made["parks"].collect()) == (["Sea World"] if loose else ["Sea World", "magic", "sea"])
    again = imports.import_menus(rows, parks.unionByName(made["parks"]), restaurants.unionByName(made["restaurants"].select(restaurants.columns)), items.unionByName(made["items"]), loose)
    assert {r["verdict"] for r in again.where("row_id < 7").collect()} == {"duplicate"}
    assert again.where(F.col("new_park_id") | F.col("new_restaurant_id")).count() == 0


def test_approval_is_safe_for_nulls(spark):
    rows = spark.createDataFrame([(70, True, False), (69, True, False), (None, True, False), (80, False, False), (80, True, True), (80, None, None)], "confidence int, has_nutrition boolean, needs_manual boolean")
    assert [r["approved"] for r in imports.approved(rows).collect()] == [True, False, False, False, False, False]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_names_are_not_broadcast(spark):
    # A name of 30 characters has hundreds of keys; the planner counts the file that the name came from.
    names = stored(spark.createDataFrame([("p", f"grilled chicken sandwich {i:03d}") for i in range(60)] + [(None, "none"), ("q", None)], "block string, name string"), "names")
    for pairs in (matching.edit_pairs(names, names, 0.75), matching.contained_pairs(names, names), matching.half_pairs(names, names, 3)):
        assert "BroadcastHashJoin" not in _plan(pairs)
        assert pairs.where("asked = known").count() == 60


def test_parts_of_known_names_are_not_broadcast(spark):
    known = stored(spark.createDataFrame([(i, f"The Old Smokehouse {i}") for i in range(50)], "id long, name string"), "known")
    found = matching.within(known.select("name"), known)
    assert not any("Generate" in part for part in _plan(found).split("BroadcastExchange")[1:])
    assert found.where("asked = 'the old smokehouse 1'").count() == 11


def test_narrow_catalogue_has_the_rows_of_the_wide_one(spark):
    cat = Catalogue(spark, SMOKE_FOLDER)
    columns = ["item_id", "restaurant_id", "name", "restaurant_name", "park_name", "calories", "sodium"]
    assert sorted(map(str, cat.wide_of(*columns).collect())) == sorted(map(str, cat.wide.select(*columns).collect()))


def test_photos_take_turns_without_a_job_for_each_loser(spark):
    # 60 photos of two kinds want the same 60 items: rounds that move losers by one place took dozens of jobs.
    items = spark.createDataFrame([(i, "p", "Grilled Chicken Sandwich") for i in range(60)] + [(100 + i, "q", "Grilled Chicken Sandwich") for i in range(3)], "item_id long, park string, name string")
    photos = spark.createDataFrame([(i, "p", ["grilled", "chicken", "large" if i % 2 else "classic"]) for i in range(70)] + [(100, "q", ["chicken", "sandwich"])], "photo_id long, park string, keywords array<string>")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = {r["photo_id"]: r["item_id"] for r in resolve.match_photos(photos, items).collect()}
    assert found == {**{i: i for i in range(60)}, 100: 100}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 120


def test_photos_against_taking_turns(spark):
    rng = random.Random(11)
    words = ("grilled", "chicken", "turkey", "salad", "large", "sandwich")
    items = [(i, rng.choice("pq"), " ".join(rng.sample(words, rng.randrange(2, 5)))) for i in rng.sample(range(500), 60)]
    photos = [(i, rng.choice("pq"), [rng.choice(words) for _ in range(rng.randrange(2, 5))]) for i in rng.sample(range(500), 70)]
    want, taken = {}, set()
    for photo, park, keywords in sorted(photos):
        scores = []
        for item, where, name in items:
            own = set(name.split(" "))
            hits = sum(k in own for k in keywords)
            if where == park and item not in taken and hits >= 2 and hits / len(own) ** 0.5 >= 0.6:
                scores.append((-hits / len(own) ** 0.5, item))
        if scores:
            taken.add(min(scores)[1])
            want[photo] = min(scores)[1]
    found = resolve.match_photos(spark.createDataFrame(photos, "photo_id long, park string, keywords array<string>"), spark.createDataFrame(items, "item_id long, park string, name string"))
    assert {r["photo_id"]: r["item_id"] for r in found.collect()} == want


def test_repeated_photos_and_items(spark):
    # An item is taken once, under whatever name; a repeated photo has a turn for each row.
    items = spark.createDataFrame([(1, "p", "Grilled Chicken"), (1, "p", "Grilled Chicken"), (2, "p", "Grilled Chicken"), (2, "p", "Turkey Leg"), (3, "p", "Turkey Leg")], "item_id long, park string, name string")
    photos = [(1, "p", ["grilled", "chicken"]), (2, "p", ["grilled", "chicken"]), (3, "p", ["turkey", "legs", "turkey"]), (4, "p", ["turkey", "large", "turkey"])]
    rows = lambda given: sorted(tuple(r)[:2] for r in resolve.match_photos(spark.createDataFrame(given, "photo_id long, park string, keywords array<string>"), items).collect())
    assert rows(photos) == [(1, 1), (1, 1), (2, 2), (3, 3)]
    assert rows([photos[0], photos[0]]) == [(1, 1)] * 4 + [(1, 2)] * 2
