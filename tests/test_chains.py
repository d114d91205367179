"""Chain matching against a plain version over random names."""

import random

from pyspark.sql import functions as F

from trencher.operators import chains, matching

WORDS = ("fish", "fry", "big", "red", "ox", "of", "taco", "burger", "zest")


def plain(asked, known):
    if asked == known:
        return 1.0
    if asked in known or known in asked:
        return 0.9
    a, b = ({w for w in x.split(" ") if len(w) > 2} for x in (asked, known))
    return len(a & b) / max(len(a), len(b)) if a or b else 0.0


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    name = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 5)))
    places = [(1, "The Grill 1"), (2, "GRILL 2"), (3, "Old Bakery"), (4, None)]
    items = [(i, rng.randrange(1, 5), name(), rng.choice([None, f"n{i}", f"n{i}"]), rng.choice([None, 40, 84, 85, 99])) for i in range(60)]
    given = [(i, *rng.choice([("grill", None), ("Bistro", ["bakery", None]), ("grill", ["bakery"]), ("none", ["nothing"]), (None, ["grill"])]), name()) for i in range(80)]
    found = chains.match_chains(spark.createDataFrame(given, "chain_item_id long, chain string, aliases array<string>, name string"),
                                spark.createDataFrame(places, "restaurant_id long, restaurant_name string"),
                                spark.createDataFrame(items, "item_id long, restaurant_id long, name string, nutrition_id string, confidence_score int"))
    mine = {r["chain_item_id"]: (r["item_id"], r["score"], r["status"], r["written"]) for r in found.collect()}

    of_chain = {"grill": (1, 2), "Bistro": (3,)}
    best = {}
    for i, chain, _, asked in given:
        scores = [(-plain(asked, it[2]), it[0]) for it in items if asked is not None and it[2] is not None and it[1] in of_chain.get(chain, ())]
        score, item = min((s for s in scores if -s[0] >= 0.5), default=(None, None))
        record = next((it for it in items if it[0] == item), None)
        status = "no match" if record is None else "no record" if record[3] is None else "trusted" if (record[4] or 0) >= 85 else "updated"
        best[i] = (item, None if score is None else -score, status)
    last = {item: max(i for i, b in best.items() if b[0] == item and b[2] == "updated") for item, _, status in best.values() if status == "updated"}
    assert mine == {i: (*b, b[2] == "updated" and last[b[0]] == i) for i, b in best.items()}
    assert {b[2] for b in best.values()} == {"no match", "no record", "trusted", "updated"}


def test_long_names_meet_what_they_hold(spark):
    chain = "the grand old smokehouse and trading company of the northern lakes"
    dish = "slow smoked brisket with seven pickles, two breads, three sauces and a side"
    places = [(1, f"Best of the west: {chain.title()} {'far away ' * 30}"), (2, "Other")]
    items = [(1, 1, f"{'very ' * 60}{dish}", "n1", 40), (2, 1, dish[:70], "n2", 99), (3, 2, dish, "n3", 40)]
    given = [(1, chain, None, dish), (2, "none", [chain.upper()], dish[:70]), (3, chain, None, f"{dish} {'every day ' * 30}")]
    found = chains.match_chains(spark.createDataFrame(given, "chain_item_id long, chain string, aliases array<string>, name string"),
                                spark.createDataFrame(places, "restaurant_id long, restaurant_name string"),
                                spark.createDataFrame(items, "item_id long, restaurant_id long, name string, nutrition_id string, confidence_score int"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 0.9, "updated", True), (2, 2, 1.0, "trusted", False), (3, 2, 0.9, "trusted", False)]
    assert min(map(len, (places[0][1], items[0][2], given[2][3]))) > matching.LONG and min(map(len, (chain, dish[:70]))) >= matching.GRAM


def test_plain_names(spark):
    rows = [("Mega™ Fries (Large) ", "mega fries"), ("A - B", "a b"), ("Big  (one) Mac", "big mac"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "name string, want string").select(chains.plain_name(F.col("name")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
