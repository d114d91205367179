"""Menus in payloads and pages, malformed ones among them."""

import json

from trencher.sources import menus

value = lambda x: {"Values": [x]}
inner = lambda xs: {"EmbeddedValues": xs}


def new(*dishes):
    return {"a": [{"sections": inner([{"items": inner([{"heading": value(n), "description": value(d)} for n, d in dishes])}])}]}


def old(*dishes, title=menus.OLD_SCHEMA):
    menu = inner([{"DishDetails": inner([{"Title": value(n), "ShortDescription": value(d), "Price": value(p)} for n, d, p in dishes])}])
    return {"ComponentPresentations": [{"Component": {"Schema": {"Title": title}, "Fields": {"MenuDetails": menu}}}, {}, None]}


def test_payloads(spark):
    nested = new(("Taco", "x"), ("TACO", "again"), ("Allergen Note: nuts", "x"), ("Iced Tea", ""))
    nested["z"] = new(("Soup", "later"))
    payloads = {
        1: json.dumps(nested), 2: json.dumps(old(("Pie", " <b>sweet &amp; sour</b> ", "$ 4.50 each"), ("Water", "w", "free"))), 3: json.dumps(old(("Pie", "x", "1"), title="Other")),
        4: "<html>", 5: None, 6: "[]", 7: "3", 8: json.dumps({"sections": {"EmbeddedValues": [None, {"items": 3}]}, "ComponentPresentations": 5}), 9: "[" * 100_000,
        10: json.dumps({**new((None, "x")), **old(("Fries", None, None))}), 11: json.dumps(old(("Odd", "", "1.2.3"))),
    }
    found = {}
    for r in menus.menu_payloads(spark.createDataFrame(list(payloads.items()), "payload_id long, content string")).collect():
        found.setdefault(r["payload_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {
        1: [(1, "Taco", "x", None, None), (2, "Iced Tea", None, None, "beverage"), (3, "Soup", "later", None, None)],
        2: [(1, "Pie", "sweet & sour", 4.5, "dessert"), (2, "Water", "w", None, "beverage")], 10: [(1, "Fries", None, None, "side")], 11: [(1, "Odd", None, 1.2, None)]}


def test_pages(spark):
    pages = {
        1: "<table><tr><th>Dish</th></tr><TR class='a'><td>Fish &amp; Chips</td><td> <i>crisp</i> </td><td>about $12.50</td></TR><tr><td>ab</td></tr></table><ul><li>Not this</li></ul>",
        2: "<nav><ul><li><a href='/x'>Home</a></li></ul></nav><article><ol><li>Corn Dog - $6.25</li><li>Churro<!-- - $3 --></li><li>x</li></ol></article>", 3: None, 4: "", 5: "<li>open",
        6: "<ul>" + "<li>Very long - 3</li>" * 5000 + "</ul>",
    }
    given = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    found = {}
    for r in menus.menu_pages(given).collect():
        found.setdefault(r["page_id"], []).append(tuple(r)[1:])
    assert found[1] == [(1, "Fish & Chips", "crisp", 12.5, None)] and len(found[6]) == 5000 and found[6][-1] == (5000, "Very long", None, 3.0, None)
    assert found[2] == [(1, "Home", None, None, None), (2, "Corn Dog", None, 6.25, "side"), (3, "Churro", None, None, "dessert")] and not found.keys() & {3, 4, 5}
    assert [r["name"] for r in menus.menu_pages(given.where("page_id = 2"), scope="article").collect()] == ["Corn Dog", "Churro"]


def test_a_page_is_parsed_once(spark):
    given = spark.createDataFrame([(1, "<tr><td>Fish</td></tr>")], "page_id long, html string")
    plan = menus.menu_pages(given)._jdf.queryExecution().optimizedPlan().toString()
    # Rows, items and cells each once; comments are taken out of three cells of a row and of an item.
    assert [plan.count(part) for part in ("<tr(", "<li(", "<td(", "<!--")] == [1, 1, 1, 4]
