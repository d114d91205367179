"""The driver tables read as a catalogue.

``part`` are items, ``lineitem`` their (many) nutrition records, ``supplier``
the restaurants, ``nation`` the parks.  Names, descriptions and nutrients are
derived from the row's own columns, with gaps and errors at fixed rates, so that
every rule, check and repair has rows to work on and the work grows with the
tables.  The expressions are plain SQL text that both engines understand; the
checking SQL in this package starts from the same text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trencher.operators.assemble import first_nutrition, wide_items
from trencher.operators.storage import stored

# (dish, category) drawn by part size and brand.
DISHES = (
    ("Cheeseburger", "entree"), ("Turkey Leg", "snack"), ("Caesar Salad", "entree"), ("Side Salad", "side"),
    ("Bottled Water", "beverage"), ("Brewed Coffee", "beverage"), ("Caffe Latte", "beverage"), ("Iced Tea", "beverage"),
    ("Lemonade", "beverage"), ("Margarita", "beverage"), ("Draft Beer", "beverage"), ("Merlot Wine", "beverage"),
    ("Root Beer Float", "dessert"), ("Beer Battered Fish", "entree"), ("Fish and Chips", "entree"), ("Chicken Tenders", "entree"),
    ("Fried Chicken", "entree"), ("Buffalo Wings", "snack"), ("Loaded Nachos", "snack"), ("French Fries", "side"),
    ("Onion Rings", "side"), ("Mac and Cheese", "side"), ("Spaghetti Pasta", "entree"), ("Pepperoni Pizza", "entree"),
    ("Cheese Flatbread", "entree"), ("Hot Dog", "entree"), ("Corn Dog", "snack"), ("Chili Cheese Dog", "entree"),
    ("Beef Taco", "entree"), ("Chicken Burrito", "entree"), ("Veggie Wrap", "entree"), ("Club Sandwich", "entree"),
    ("Pulled Pork Platter", "entree"), ("BBQ Ribs", "entree"), ("Ribeye Steak", "entree"), ("Grilled Salmon", "entree"),
    ("Shrimp Cocktail", "snack"), ("Lobster Bisque", "side"), ("Clam Chowder", "side"), ("Tomato Soup", "side"),
    ("Beef Chili", "entree"), ("Edamame", "side"), ("Fruit Cup", "side"), ("Garlic Bread", "side"),
    ("Steamed Rice", "side"), ("Baked Potato", "side"), ("Chocolate Cake", "dessert"), ("Funnel Cake", "dessert"),
    ("Churro", "dessert"), ("Cupcake", "dessert"), ("Brownie", "dessert"), ("Chocolate Chip Cookie", "dessert"),
    ("Ice Cream Sundae", "dessert"), ("Dole Whip", "dessert"), ("Glazed Donut", "dessert"), ("Apple Pie", "dessert"),
    ("Cinnamon Roll", "dessert"), ("Soft Pretzel", "snack"), ("Popcorn", "snack"), ("Cotton Candy", "dessert"),
    ("Milkshake", "beverage"), ("Strawberry Smoothie", "beverage"), ("Hot Chocolate", "beverage"), ("Orange Juice", "beverage"),
    ("Diet Coke", "beverage"), ("Coca-Cola", "beverage"), ("Espresso Martini", "beverage"), ("Old Fashioned", "beverage"),
    ("Bourbon Flight", "beverage"), ("White Claw Hard Seltzer", "beverage"), ("Choose Your Sauce", "side"), ("2% Milk", "beverage"),
    ("3 Cheese Pizza", "entree"), ("2. CHOOSE MIX-INS", "dessert"), ("-- Tiramisu", "dessert"), ("Souvenir Mug", "beverage"),
    ("Chicken Nuggets", "entree"), ("Whole Cheese Pizza", "entree"), ("Family Platter", "entree"), ("Vegetable Platter", "side"),
    ("Grilled Chicken Sandwich", "entree"), ("Impossible Burger", "entree"), ("Peanut Butter Fudge", "dessert"), ("Egg Roll", "snack"),
    ("Teriyaki Rice Bowl", "entree"), ("Poke Bowl", "entree"), ("Cheese Quesadilla", "entree"), ("Buttermilk Pancakes", "entree"),
    ("Bacon and Eggs", "entree"), ("Oatmeal", "entree"), ("Cheesecake", "dessert"), ("Key Lime Tart", "dessert"),
)
PREFIXES = ("", "", "Signature ", "Large ", "Kids ", "Spicy ", "Frozen ", "Classic ")
DESCRIPTIONS = (
    None, "", "Rum and fruit punch", "Sweet glaze with caramel drizzle", "Served with fries and coleslaw",
    "Topped with bacon, cheese and ranch", "16 oz draft", "Vegan and dairy-free", "Contains peanuts and milk",
    "Two shots of vodka, gin and amaretto", "Crispy battered cod with tartar sauce", "Whole wheat bun, lettuce and tomato",
    "Choice of chicken or shrimp over rice", "Flight of three 4 oz pours", "Gluten-free on request",
    "Loaded with beans, sour cream and guacamole", "Sea salt and butter",
)
PLACES = (
    "Grill", "Tavern", "Cantina", "Cafe", "Bar Lounge", "Bakery", "Pizzeria", "Smokehouse", "Snack Cart",
    "Ice Cream Parlor", "Taproom", "Noodle House", "Fish Market", "Sweet Shop",
)
LANDS = (None, "Main Street", "Adventureland", " World Showcase ", "Frontierland")
PARKS = (
    "Magic Kingdom", "EPCOT", "Disney's Hollywood Studios", "Animal Kingdom", "Typhoon Lagoon", "Disney Springs",
    "Walt Disney World Resort Hotels", "Disneyland Park", "Disney California Adventure", "Downtown Disney",
    "Universal Studios Florida", "Islands of Adventure", "Universal Epic Universe", "Universal's Epic Universe",
    "Universal Volcano Bay", "Universal CityWalk", "Universal Cabana Bay", "Disney Dream", "SeaWorld Orlando",
    "Busch Gardens Tampa", "Aulani", "Dollywood", "Kings Island", "Local Fair", "County Expo",
)
#: The order in which an item's records are looked at.
FIRST = ("order_id", "line", "restaurant_id")
ALLERGENS = ("milk", "Wheat", "egg", "peanut", "tree nut", "soy", "fish", "shellfish", "sesame")


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _pick(values, index: str, engine: str) -> str:
    body = ", ".join(quoted(v) for v in values)
    if engine == "spark":
        # Spark reads a doubled quote as concatenation, so quotes are escaped instead.
        body = body.replace("''", "\\'") if any(v and "'" in v for v in values) else body
        return f"element_at(array({body}), CAST({index} AS INT) + 1)"
    return f"list_extract([{body}], CAST({index} AS INT) + 1)"


def _park_columns(engine: str) -> list[str]:
    return [
        "n_nationkey AS park_id",
        f"{_pick(PARKS, 'n_nationkey % 25', engine)} AS park_name",
        "n_regionkey AS region_id",
    ]


def _restaurant_columns(engine: str) -> list[str]:
    return [
        "s_suppkey AS restaurant_id",
        f"concat({_pick(PLACES, 's_suppkey % 14', engine)}, ' ', CAST(s_suppkey % 10 AS VARCHAR(9))) AS restaurant_name",
        "s_nationkey AS park_id",
        f"{_pick(LANDS, 'floor(s_suppkey / 3) % 5', engine)} AS land",
    ]


def _item_columns(engine: str) -> list[str]:
    brand = "CAST(substr(p_brand, 7) AS INT)"
    dish = f"((p_size * 31 + {brand} * 7) % {len(DISHES)})"
    word = "split_part(p_name, ' ', 1)"
    colours = ("blue", "red", "new", "large", "small", "hot", "cold", "old")
    prefix = "CASE " + " ".join(f"WHEN {word} = '{w}' THEN '{p}'" for w, p in zip(colours, PREFIXES, strict=True)) + " ELSE '' END"
    name = f"concat({prefix}, {_pick([d for d, _ in DISHES], dish, engine)})"
    return [
        "p_partkey AS item_id",
        f"CASE WHEN p_partkey % 41 = 0 THEN concat('<b>', {name}, '</b> ') WHEN p_partkey % 37 = 0 THEN concat('? ', {name}, ' &amp; Dip')"
        f" WHEN p_partkey % 401 = 0 THEN '  ' ELSE {name} END AS name",
        f"{_pick(DESCRIPTIONS, f'(p_partkey + p_size) % {len(DESCRIPTIONS)}', engine)} AS description",
        "CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE CAST(floor(p_retailprice / 25) * 0.25E0 AS DECIMAL(10,2)) END AS price",
        f"CASE WHEN p_partkey % 9 = 0 THEN 'entree' ELSE {_pick([c for _, c in DISHES], dish, engine)} END AS category",
        "p_size % 11 = 0 AS is_seasonal",
        f"({dish} IN (13, 14, 15, 16, 17, 19, 20, 26, 47, 48, 54)) AS is_fried",
        f"({dish} IN (3, 22, 24, 30, 41, 42, 44, 45, 79, 81, 86)) AS is_vegetarian",
        "CASE WHEN p_partkey % 3 = 0 THEN concat('https://img.example.com/', CAST(p_partkey AS VARCHAR(20)), '.jpg') END AS photo_url",
    ]


def _nutrition_columns(engine: str) -> list[str]:
    e = "CAST(floor(l_extendedprice) AS INT)"
    q, d, t = "CAST(l_quantity AS INT)", "CAST(round(l_discount * 100) AS INT)", "CAST(round(l_tax * 100) AS INT)"
    carbs, fat, protein = f"({q} + {e} % 40)", f"({d} * 3 + {e} % 17)", f"({t} * 4 + {e} % 23)"
    energy = f"(4 * {carbs} + 4 * {protein} + 9 * {fat})"
    div = lambda a, b: f"CAST(floor(({a}) / {b}) AS INT)"
    return [
        "l_partkey AS item_id",
        "l_suppkey AS restaurant_id",
        "l_orderkey AS order_id",
        "l_linenumber AS line",
        "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS nutrition_id",
        f"CASE WHEN {e} % 31 = 0 THEN NULL WHEN {e} % 29 = 0 THEN 0 WHEN {e} % 211 = 0 THEN -50 WHEN {e} % 199 = 0 THEN 5200 + {q}"
        f" WHEN {e} % 5 = 0 THEN {div(f'{energy} * (50 + {e} % 120)', 100)} ELSE {energy} + {e} % 20 - 10 END AS calories",
        f"CASE WHEN {e} % 37 = 0 THEN NULL ELSE {carbs} END AS carbs",
        f"CASE WHEN {e} % 41 = 0 THEN NULL WHEN {e} % 13 = 0 THEN 0 ELSE {fat} END AS fat",
        f"CASE WHEN {e} % 43 = 0 THEN NULL WHEN {e} % 11 = 0 THEN 0 ELSE {protein} END AS protein",
        f"CASE WHEN {e} % 7 = 0 THEN NULL WHEN {e} % 6 = 0 THEN 0 ELSE {div(f'{carbs} * ({e} % 13)', 10)} END AS sugar",
        f"CASE WHEN {e} % 9 = 0 THEN NULL WHEN {e} % 8 = 0 THEN 0 WHEN {e} % 53 = 0 THEN {carbs} + 5 ELSE {e} % 9 END AS fiber",
        f"CASE WHEN {e} % 10 = 0 THEN NULL WHEN {e} % 12 = 0 THEN 0 WHEN {e} % 97 = 0 THEN 12000 + {e} % 1000 ELSE ({e} * 7) % 2600 END AS sodium",
        f"CASE WHEN {e} % 14 = 0 THEN NULL ELSE ({e} * 3) % 300 END AS cholesterol",
        f"CASE WHEN {e} % 4 = 0 THEN {e} % 30 WHEN {e} % 3 = 0 THEN 0 ELSE NULL END AS alcohol_grams",
        "CASE l_returnflag WHEN 'A' THEN 'official' WHEN 'N' THEN 'api_lookup' ELSE 'crowdsourced' END AS source",
        f"({e} * 13) % 101 AS confidence_score",
        "l_shipdate AS nutrition_created_at",
    ]


def _allergen_columns(engine: str) -> list[str]:
    brand = "CAST(substr(p_brand, 7) AS INT)"
    return [
        "p_partkey AS item_id",
        f"{_pick(ALLERGENS, 'p_size % 9', engine)} AS first_type",
        f"{_pick(ALLERGENS, f'{brand} % 9', engine)} AS second_type",
        "CASE WHEN p_size % 2 = 0 THEN 'contains' ELSE 'may_contain' END AS severity",
    ]


@dataclass
class Catalogue:
    """Lazily built DataFrames over one scale-factor folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parks(self) -> DataFrame:
        return self.table("nation").selectExpr(*_park_columns("spark"))

    @cached_property
    def restaurants(self) -> DataFrame:
        return self.table("supplier").selectExpr(*_restaurant_columns("spark"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").selectExpr(*_item_columns("spark"))

    @cached_property
    def nutrition(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*_nutrition_columns("spark"))

    @cached_property
    def allergens(self) -> DataFrame:
        pairs = self.table("part").where("p_partkey % 3 <> 0").selectExpr(*_allergen_columns("spark"))
        return pairs.select(
            "item_id", F.explode(F.array_distinct(F.array("first_type", "second_type"))).alias("allergen_type"), "severity"
        )

    @cached_property
    def wide(self) -> DataFrame:
        """One row per item with its first nutrition record, restaurant and park."""
        first = first_nutrition(self.nutrition, order=FIRST)
        return wide_items(self.items, first, self.restaurants, self.parks)

    def wide_of(self, *columns: str) -> DataFrame:
        """These columns of ``wide``, stored: records are narrowed before the first one is sought, and that once for all readers."""
        records = self.nutrition.select(*[c for c in self.nutrition.columns if c in ("item_id", *FIRST, *columns)])
        return stored(wide_items(self.items, first_nutrition(records, order=FIRST), self.restaurants, self.parks).select(*columns), "wide")


def base_sql() -> str:
    """``WITH`` clause that gives the checking engine the same base views."""
    cols = lambda make: ", ".join(make("duckdb"))
    return f"""WITH parks AS (SELECT {cols(_park_columns)} FROM nation),
restaurants AS (SELECT {cols(_restaurant_columns)} FROM supplier),
items AS (SELECT {cols(_item_columns)} FROM part),
nutrition AS (SELECT {cols(_nutrition_columns)} FROM lineitem),
allergens AS (SELECT item_id, allergen_type, severity FROM (
  SELECT DISTINCT item_id, severity, unnest([first_type, second_type]) AS allergen_type
  FROM (SELECT {cols(_allergen_columns)} FROM part WHERE p_partkey % 3 <> 0))),
first_nutrition AS (SELECT * FROM nutrition
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY order_id, line, restaurant_id) = 1),
wide AS (SELECT i.*, n.restaurant_id, r.restaurant_name, r.land, r.park_id, p.park_name, p.region_id,
  n.nutrition_id, n.calories, n.carbs, n.fat, n.protein, n.sugar, n.fiber, n.sodium, n.cholesterol,
  n.alcohol_grams, n.source, n.confidence_score, n.nutrition_created_at
  FROM items i LEFT JOIN first_nutrition n USING (item_id)
  LEFT JOIN restaurants r ON r.restaurant_id = n.restaurant_id
  LEFT JOIN parks p ON p.park_id = r.park_id)
"""
