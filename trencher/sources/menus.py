"""Menu rows from JSON payloads of a content system and from HTML pages.

A payload or page is one row and stays in its task; its items are exploded, so
no group is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.text import decode_entities, edges, strip_tags

# Names that are no dishes, the schema of the older layout, and the least length of a name on a page.
NOT_A_DISH, OLD_SCHEMA, LEAST_NAME = "allergen note", "K2 Restaurant Menu", 3
BLANK = r"[\s ]"


def infer_category(name: Column) -> Column:
    """Category by the words of a scraped name, first rule first; null where none fits."""
    n = F.lower(name)
    word = lambda words: n.rlike(edges(rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])"))
    # The words of each category.
    drinks = "drink|soda|lemonade|tea|coffee|smoothie|shake|beer|wine|cocktail|margarita|juice|water|milk"
    sweets = "cookie|cake|brownie|sundae|ice cream|gelato|mousse|pudding|churro|funnel|waffle|donut|cupcake|pie|tart|cobbler|crisp"
    sides = "fries|coleslaw|corn|rice|beans|side salad|fruit cup|tots|onion rings"
    snacks = "snack|popcorn|churro|pretzel|corn dog|turkey leg|wings|nachos|dip"
    return F.when(word(drinks), "beverage").when(word(sweets) & ~n.contains("crispy"), "dessert").when(word(sides), "side").when(word(snacks), "snack")


def _value(field):
    """The first of a field's ``Values``; None where there is none."""
    values = field.get("Values") if isinstance(field, dict) else None
    return values[0] if isinstance(values, list) and values and isinstance(values[0], str) else None


def _embedded(holder) -> list:
    found = holder.get("EmbeddedValues") if isinstance(holder, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def _sectioned(data) -> list:
    """Dishes of the newer layout, wherever in the payload its ``sections`` are; outer ones first."""
    found, open_ = [], [data]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            found += [(_value(dish.get("heading")), _value(dish.get("description")), None) for section in _embedded(x.get("sections")) for dish in _embedded(section.get("items"))]
        open_ += reversed(list(x.values()) if isinstance(x, dict) else [y for y in x if isinstance(y, (dict, list))] if isinstance(x, list) else [])
    return found


def _presented(data) -> list:
    """Dishes of the older layout."""
    shown = data.get("ComponentPresentations") if isinstance(data, dict) else None
    parts = [p["Component"] for p in shown if isinstance(p, dict) and isinstance(p.get("Component"), dict)] if isinstance(shown, list) else []
    menus = [p["Fields"].get("MenuDetails") for p in parts if isinstance(p.get("Schema"), dict) and p["Schema"].get("Title") == OLD_SCHEMA and isinstance(p.get("Fields"), dict)]
    return [(_value(dish.get("Title")), _value(dish.get("Description")) or _value(dish.get("ShortDescription")), _value(dish.get("Price")) or "")
            for menu in menus for section in _embedded(menu) for dish in _embedded(section.get("DishDetails"))]


def menu_payloads(payloads: DataFrame, key: str = "payload_id", content: str = "content") -> DataFrame:
    """``key, at, name, description, price, category`` of the dishes in JSON payloads, numbered from 1.

    The newer layout counts where it has dishes, else the older one.  Names that
    hold ``NOT_A_DISH`` are none; of names equal but for case the first counts.
    Prices are the digits of their text, null where these are no number.  A
    payload that is null or no JSON has no rows here: it goes to ``menu_pages``.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = ([], [], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    data = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                named = lambda dishes: [d for d in dishes if d[0] and NOT_A_DISH not in d[0].lower()]
                for at, (name, description, price) in enumerate(named(_sectioned(data)) or named(_presented(data))):
                    for column, v in zip(rows, (i, at, name, description, price)):
                        column.append(v)
            text = pa.string()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), *[pa.array(c, text) for c in rows[2:]]],
                                             ["key", "at", "name", "description", "price"])

    kind = payloads.schema[key].dataType.simpleString()
    found = payloads.select(key, F.col(content).cast("string")).mapInArrow(run, f"key {kind}, at int, name string, description string, price string")
    cleaned = F.trim(strip_tags(F.replace(F.col("description"), F.lit("&amp;"), F.lit("&"))))
    old = F.col("price").isNotNull()
    rows = found.select("key", "at", "name", F.when(old, cleaned).otherwise(F.col("description")).alias("description"), _number(F.regexp_replace("price", "[^0-9.]", "")).alias("price"))
    return _first_names(rows).withColumnRenamed("key", key)


def _number(text: Column) -> Column:
    """The number a text begins with; null where it begins with none."""
    return F.regexp_extract(text, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def _first_names(rows: DataFrame) -> DataFrame:
    """The first row of each name of a key, whatever its case, numbered anew."""
    # One shuffle by key serves both groupings.
    first = rows.repartition("key").groupBy("key", F.lower("name").alias("lower_")).agg(F.min(F.struct("at", "name", "description", "price")).alias("x"))
    own = F.array_sort(F.collect_list(F.struct("x.at", "x.name", "x.description", "x.price")))
    # The dishes of one payload, which came in one row.
    return first.groupBy("key").agg(own.alias("own")).select("key", F.posexplode("own").alias("n", "x")).select(
        "key", (F.col("n") + 1).alias("at"), "x.name", F.when(F.col("x.description") != "", F.col("x.description")).alias("description"), "x.price", infer_category(F.col("x.name")).alias("category"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once: a column that names another one twice computes it twice."""
    return F.transform(F.array(value), then)[0]


def _text(html: Column) -> Column:
    bare = strip_tags(F.regexp_replace(html, "(?s)<!--.*?-->", ""))
    return _once(bare, lambda x: F.regexp_replace(decode_entities(x), f"^{BLANK}+|{BLANK}+$", ""))


def _parts(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))


def menu_pages(pages: DataFrame, key: str = "page_id", html: str = "html", scope: str | None = None) -> DataFrame:
    """``key, at, name, description, price, category`` of the dishes on HTML pages, numbered from 1.

    Rows of tables are dishes: cells are name, description and price.  A page
    without such rows has its list items, ``name - $price`` or a name alone;
    ``scope``: only lists inside this tag count.  Names of fewer than
    ``LEAST_NAME`` characters are none.  A null page has no rows.
    """
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")

    def of_row(row: Column) -> Column:
        cell = lambda n: F.try_element_at(row, F.lit(n))
        return F.struct(F.coalesce(_text(cell(1)), F.lit("")).alias("name"), cell(2).alias("description"), cell(3).alias("price"))

    def of_item(item: Column) -> Column:
        priced = r"(?s)^(.+?)\s*[-–]\s*\$?([\d.]+)$"
        return _once(_text(item), lambda text: F.struct(
            F.when(text.rlike(edges(priced)), F.trim(F.regexp_extract(text, priced, 1))).otherwise(text).alias("name"), none.alias("description"),
            F.regexp_extract(text, priced, 2).alias("price")))

    dishes = lambda c: F.filter(c, lambda d: F.length(d["name"]) >= LEAST_NAME)
    within = F.array_join(_parts(page, scope), "") if scope else page
    cells = F.transform(_parts(page, "tr"), lambda row: _parts(row, "td"))
    rows = pages.select(F.col(key).alias("key"), dishes(F.transform(cells, of_row)).alias("rows"), within.alias("within"))
    rows = rows.select("key", F.when(F.size("rows") > 0, F.col("rows")).otherwise(dishes(F.transform(_parts(F.col("within"), "li"), of_item))).alias("dishes"))
    # From an outer explode no filter on the dishes is inferred, which would parse each page once more.
    found = rows.select("key", F.posexplode_outer("dishes").alias("n", "d")).where("n IS NOT NULL")
    price = F.regexp_extract(_text(F.col("d.price")), r"\$?([\d.]+)", 1)
    return found.select(F.col("key").alias(key), (F.col("n") + 1).alias("at"), "d.name", _once(_text(F.col("d.description")), lambda x: F.when(x != "", x)).alias("description"),
                        _number(price).alias("price"), infer_category(F.col("d.name")).alias("category"))
