"""Daily audit state, meal and trip totals, fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.operators import daily, meals, search
from trencher.operators.browse import PAGE, FilterSpec
from trencher.plans.browse import SCORED
from trencher.plans.registry import query

# --- daily state: restaurants are datasets, shipping days are audit days -----------

DAY_COUNTS = {
    "high": "round(l_discount * 100) = 10 AND round(l_tax * 100) = 8",
    "medium": "round(l_discount * 100) = 9 AND round(l_tax * 100) < 2",
    "low": "l_returnflag = 'R'",
    "auto_fixes": "l_quantity = 1",
}
DAYS_SQL = "days AS (SELECT l_suppkey AS dataset, CAST(l_shipdate AS DATE) AS day, " + ", ".join(
    f"count(*) FILTER ({c}) AS {n}" for n, c in DAY_COUNTS.items()) + " FROM lineitem GROUP BY 1, 2)"


def _days(cat):
    lines = cat.table("lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("dataset"), F.to_date("l_shipdate").alias("day")).agg(
        *[F.count_if(F.expr(c)).alias(n) for n, c in DAY_COUNTS.items()])


@query("graduation_by_day", f"""WITH RECURSIVE {DAYS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY day) AS k, high + medium + auto_fixes = 0 AS clean FROM days),
state AS (SELECT dataset, k, CAST(clean AS BIGINT) AS clean_days, 'daily' AS mode FROM n WHERE k = 1
  UNION ALL SELECT n.dataset, n.k, CASE WHEN clean THEN s.clean_days + 1 ELSE 0 END,
    CASE WHEN clean AND s.clean_days + 1 >= 14 THEN 'weekly' WHEN high + medium > 0 THEN 'daily' ELSE s.mode END
  FROM state s JOIN n ON n.dataset = s.dataset AND n.k = s.k + 1)
SELECT dataset, day, high, medium, low, auto_fixes, clean_days, mode FROM n JOIN state USING (dataset, k)""", base=False)
def graduation_by_day(cat):
    return daily.graduation(_days(cat))


@query("recent_history", f"""WITH {DAYS_SQL} SELECT d.* FROM days d
WHERE (SELECT count(*) FROM days e WHERE e.dataset = d.dataset AND e.day > d.day) < 30""", base=False)
def recent_history(cat):
    return daily.recent(_days(cat))


# --- meals are orders, trips are customers -----------------------------------------

SUMS = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in meals.NUTRIENTS)


def _entries(cat):
    return cat.nutrition.withColumnRenamed("order_id", "meal_id").withColumn("available", F.col("calories").isNotNull() & F.col("carbs").isNotNull())


@query("meal_totals", f""", m AS (SELECT order_id AS meal_id, count(*) AS item_count, {SUMS},
  count(*) FILTER (confidence_score < 70) AS low_confidence_count, count(*) FILTER (calories IS NULL OR carbs IS NULL) AS unavailable_count FROM nutrition GROUP BY order_id),
r AS (SELECT *, greatest(0, carbs - fiber) AS net_carbs, sugar::DOUBLE / nullif(carbs, 0) AS sr, protein::DOUBLE / nullif(carbs, 0) AS pr FROM m),
p AS (SELECT *, CASE WHEN calories = 0 AND carbs = 0 THEN 100 ELSE greatest(0, CAST(floor(0.4::DOUBLE * CASE WHEN net_carbs <= 15 THEN 100 WHEN net_carbs <= 30 THEN 80 WHEN net_carbs <= 45 THEN 60 WHEN net_carbs <= 60 THEN 40 WHEN net_carbs <= 80 THEN 20 ELSE 0 END
  + 0.2::DOUBLE * CASE WHEN carbs = 0 OR sr < 0.2::DOUBLE THEN 100 WHEN sr < 0.4::DOUBLE THEN 70 WHEN sr < 0.6::DOUBLE THEN 40 ELSE 10 END
  + 0.15::DOUBLE * CASE WHEN carbs = 0 OR pr > 1 THEN 100 WHEN pr > 0.5::DOUBLE THEN 75 WHEN pr > 0.25::DOUBLE THEN 50 ELSE 20 END
  + 0.15::DOUBLE * CASE WHEN fiber >= 8 THEN 100 WHEN fiber >= 5 THEN 75 WHEN fiber >= 2 THEN 50 ELSE 20 END
  + 0.1::DOUBLE * CASE WHEN calories < 300 THEN 100 WHEN calories < 500 THEN 75 WHEN calories < 700 THEN 50 ELSE 25 END + 0.5::DOUBLE) AS INT)) END AS score FROM r)
SELECT meal_id, item_count, {', '.join(meals.NUTRIENTS)}, low_confidence_count, unavailable_count, net_carbs, score,
  CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM p""")
def meal_totals(cat):
    return meals.meal_totals(_entries(cat))


@query("meal_warnings", """SELECT order_id AS meal_id, item_id, 'low_confidence' AS reason FROM nutrition WHERE confidence_score < 70
UNION SELECT order_id, item_id, 'unavailable' FROM nutrition WHERE calories IS NULL OR carbs IS NULL""")
def meal_warnings(cat):
    return meals.meal_warnings(_entries(cat))


CARB_GOAL = 60


@query("trip_totals", f""", e AS (SELECT o_custkey AS trip_id, CAST(o_orderdate AS DATE) AS day, o_orderkey AS meal_id, n.* FROM nutrition n JOIN orders ON o_orderkey = order_id),
t AS (SELECT 'meal' AS level, trip_id, day, meal_id, count(*) AS item_count, {SUMS} FROM e GROUP BY trip_id, day, meal_id
  UNION ALL SELECT 'day', trip_id, day, NULL, count(*), {SUMS} FROM e GROUP BY trip_id, day
  UNION ALL SELECT 'trip', trip_id, NULL, NULL, count(*), {SUMS} FROM e GROUP BY trip_id),
s AS (SELECT *, CASE WHEN level = 'meal' THEN least(100, CAST(floor(carbs * 100 / {CARB_GOAL}::DOUBLE + 0.5::DOUBLE) AS BIGINT)) END AS carb_pct FROM t)
SELECT *, CASE WHEN carb_pct >= 100 THEN 'red' WHEN carb_pct >= 75 THEN 'yellow' WHEN carb_pct IS NOT NULL THEN 'green' END AS carb_band FROM s""")
def trip_totals(cat):
    of_meal = cat.table("orders").select(F.col("o_orderkey").alias("meal_id"), F.col("o_custkey").alias("trip_id"), F.to_date("o_orderdate").alias("day"))
    return meals.trip_totals(_entries(cat), of_meal, CARB_GOAL)


# --- fuzzy search ------------------------------------------------------------------

ASKED = ("turky leg", "dole wip", "  Chese Pizza ", "coleslaw", "x")
FUZZY = """, asked AS (SELECT DISTINCT lower(trim(q)) AS query FROM (SELECT unnest(['turky leg', 'dole wip', '  Chese Pizza ', 'coleslaw', 'x']) AS q) WHERE length(trim(q)) >= 2),
fields AS (SELECT item_id, 'name' AS field, 2 AS weight, lower(coalesce(name, '')) AS txt FROM wide
  UNION ALL SELECT item_id, 'restaurant', 1.5, lower(coalesce(restaurant_name, '')) FROM wide UNION ALL SELECT item_id, 'description', 1, lower(coalesce(description, '')) FROM wide),
texts AS (SELECT DISTINCT field, txt FROM fields),
words AS (SELECT field, txt, query, w, t FROM (SELECT field, txt, query, unnest(regexp_split_to_array(query, '[^a-z0-9]+')) AS w, regexp_split_to_array(txt, '[^a-z0-9]+') AS ts FROM texts, asked),
  unnest(ts) AS u(t) WHERE w <> ''),
near AS (SELECT field, txt, query, w, min(CASE WHEN t <> '' THEN levenshtein(t, w)::DOUBLE / greatest(length(t), length(w)) ELSE 1 END) AS d FROM words GROUP BY field, txt, query, w),
means AS (SELECT field, txt, query, CASE WHEN contains(txt, query) THEN 0 ELSE avg(d) END AS d FROM near GROUP BY field, txt, query),
hits AS (SELECT query, item_id, CAST(floor(sum(weight::DOUBLE * CASE WHEN d <= 0.4::DOUBLE THEN d ELSE 1 END) / 4.5::DOUBLE * 1000 + 0.5::DOUBLE) AS BIGINT) AS relevance
  FROM fields JOIN means USING (field, txt) GROUP BY query, item_id HAVING min(d) <= 0.4::DOUBLE)
"""


@query("fuzzy_search", FUZZY + "SELECT query, item_id, relevance FROM hits")
def fuzzy_search(cat):
    return search.fuzzy_hits(cat.wide, ASKED)


@query("fuzzy_search_view", FUZZY + f"""SELECT query, count(*) AS total_matches, least({PAGE}, count(*)) AS visible_count, count(*) > {PAGE} AS has_more
FROM hits JOIN wide USING (item_id) WHERE carbs <= 60 AND category = 'dessert' GROUP BY query""")
def fuzzy_search_view(cat):
    """Hits of each query under a carb limit and a category, and how many of them a page shows."""
    wide = cat.wide.where((F.col("carbs") <= 60) & (F.col("category") == "dessert"))
    n = F.count(F.lit(1))
    return search.fuzzy_hits(wide, ASKED).groupBy("query").agg(n.alias("total_matches"), F.least(F.lit(PAGE).cast("long"), n).alias("visible_count"), (n > PAGE).alias("has_more"))


VISIBLE = 20
ON_TOP = FilterSpec(max_carbs=60, grades=("A", "B", "C"), allergen_free=("WHEAT",), hide_fried=True, search="fish", sort="carbsAsc")


@query("fuzzy_search_pages", FUZZY + SCORED + f""", ok AS (SELECT query, item_id, relevance, carbs FROM hits JOIN scored USING (item_id) WHERE NOT is_header AND carbs <= 60 AND grade IN ('A', 'B', 'C')
  AND item_id NOT IN (SELECT item_id FROM allergens WHERE lower(allergen_type) = 'wheat'))
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY carbs NULLS LAST, item_id) AS INT) AS position, item_id, relevance, count(*) OVER (PARTITION BY query) AS total_matches,
  count(*) OVER (PARTITION BY query) > {VISIBLE} AS has_more FROM ok QUALIFY position <= {VISIBLE}""")
def fuzzy_search_pages(cat):
    """The visible items of each query; of the filters only those that apply on top of a search count."""
    return search.search_pages(cat.wide, cat.allergens, ASKED, ON_TOP, VISIBLE)
