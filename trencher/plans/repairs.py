"""Repairs in phases, and better choices at the same restaurant."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.operators import browse, fixes, repairs
from trencher.plans.browse import SCORED
from trencher.plans.registry import query

#: Some dishes under names that the cases tell, and values that are out of range; both engines read the same text.
NAMED = ("CASE item_id % 29 WHEN 0 THEN 'Half Chicken' WHEN 1 THEN 'Seafood Stew' WHEN 2 THEN 'Coffee' ELSE name END")
CARBS, SUGAR, FIBER = "CASE WHEN item_id % 19 = 0 THEN carbs + 260 ELSE carbs END", "CASE WHEN item_id % 13 = 0 THEN carbs ELSE sugar END", "CASE WHEN item_id % 31 = 0 THEN fiber + 60 ELSE fiber END"
CHANGED = {"name": NAMED, "carbs": CARBS, "sugar": SUGAR, "fiber": FIBER}
ROUND = "CAST(floor({0} + 0.5::DOUBLE) AS INT)"


def _wide(cat):
    return cat.wide.selectExpr(*[f"CAST({CHANGED[c]} AS {cat.wide.schema[c].dataType.simpleString()}) AS {c}" if c in CHANGED else c for c in cat.wide.columns])


def _rows(source: str, updates: dict[str, str], reason: str) -> str:
    return " UNION ALL ".join(f"SELECT nutrition_id, '{f}' AS field, CAST({f} AS INT) AS before, CAST({sql} AS INT) AS after, {reason} AS reason FROM {source}" for f, sql in updates.items())


CAPPED = f"least(coalesce(confidence_score, 50), {repairs.REPAIRED})"
FEWER = ROUND.format("coalesce(calories, 800) * 0.45::DOUBLE / 4")
MUCH = "calories > 3500"
HALF = {c: f"CASE WHEN {MUCH} THEN {ROUND.format(f'{c} / 2.0::DOUBLE')} END" for c in ("carbs", "sugar", "calories", "fat", "protein", "sodium", "fiber")}
SAVOURY = f"(sugar = carbs AND carbs > 30 AND regexp_matches(lower(coalesce(name, '')), '{repairs.SAVOURY}'))"
E_SQL = "(coalesce(protein, 0) * 4 + coalesce(carbs, 0) * 4 + coalesce(fat, 0) * 9)"
CAL = "coalesce(calories, 0)"

PHASES = f""", raw AS (SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in CHANGED.items())}) FROM wide WHERE nutrition_id IS NOT NULL),
w AS (SELECT *, lower(coalesce(name, '')) AS n, lower(coalesce(name, '')) || ' ' || lower(coalesce(description, '')) AS told, protein * 4 + carbs * 4 + fat * 9 AS energy, {E_SQL} AS energy0 FROM raw),
p1 AS (SELECT *, {ROUND.format('carbs * (calories / energy::DOUBLE)')} AS c1, {ROUND.format('fat * (calories / energy::DOUBLE)')} AS f1, {ROUND.format('protein * (calories / energy::DOUBLE)')} AS r1 FROM w
  WHERE calories > 100 AND NOT coalesce(coalesce(confidence_score, 0) >= 80 AND source = 'official', false) AND category <> 'beverage' AND energy > 0 AND energy / calories::DOUBLE >= 1.3::DOUBLE),
p2 AS (SELECT *, CASE WHEN {CAL} > 0 AND energy0 > 0 AND {CAL} < energy0 * 0.2::DOUBLE THEN 'calories_too_low'
  WHEN regexp_matches(n, '{repairs.COFFEE}') AND NOT regexp_matches(told, '{repairs.NOT_PLAIN}') AND (coalesce(protein, 0) > 5 OR coalesce(carbs, 0) > 5 OR coalesce(fat, 0) > 2) THEN 'plain_coffee'
  WHEN regexp_matches(n, '{repairs.WHOLE_CHICKEN}') AND coalesce(protein, 0) < 15 AND {CAL} > 400 THEN 'chicken_protein'
  WHEN regexp_matches(n, '{repairs.SEAFOOD_STEW}') AND coalesce(protein, 0) < 10 AND {CAL} > 400 THEN 'seafood_protein'
  WHEN coalesce(fat, 0) = 0 AND {CAL} > 400 AND regexp_matches(told, '{repairs.COOKED_MEAT}') THEN 'meat_fat' END AS k FROM w WHERE energy0 >= 50 OR {CAL} >= 50),
p2k AS (SELECT * FROM p2 WHERE k IS NOT NULL),
p3 AS (SELECT * FROM w WHERE carbs > 250 OR {MUCH} OR fiber > 50 OR {SAVOURY}),
every AS (SELECT 1 AS phase, * FROM ({_rows("p1 WHERE least(c1, f1, r1) >= 0", {"carbs": "c1", "fat": "f1", "protein": "r1", "sugar": f"CASE WHEN sugar > c1 THEN {ROUND.format('c1 * 0.3::DOUBLE')} END", "confidence_score": "40"}, "'inflated_macros'")})
  UNION ALL SELECT 2, * FROM ({_rows("p2k", {
    "calories": "CASE k WHEN 'calories_too_low' THEN energy0 WHEN 'plain_coffee' THEN 5 END", "carbs": "CASE k WHEN 'plain_coffee' THEN 0 END", "sugar": "CASE k WHEN 'plain_coffee' THEN 0 END",
    "fiber": "CASE k WHEN 'plain_coffee' THEN 0 END",
    "fat": f"CASE k WHEN 'plain_coffee' THEN 0 WHEN 'meat_fat' THEN greatest({ROUND.format(f'({CAL} - coalesce(carbs, 0) * 4 - coalesce(protein, 0) * 4) / 9.0::DOUBLE')}, {ROUND.format(f'{CAL} * 0.3::DOUBLE / 9')}) END",
    "protein": f"CASE k WHEN 'plain_coffee' THEN 0 WHEN 'chicken_protein' THEN {ROUND.format(f'{CAL} * 0.25::DOUBLE / 4')} WHEN 'seafood_protein' THEN {ROUND.format(f'{CAL} * 0.2::DOUBLE / 4')} END",
    "confidence_score": f"CASE k WHEN 'plain_coffee' THEN 80 ELSE {CAPPED} END"}, "'mismatch: ' || k")})
  UNION ALL SELECT 3, * FROM ({_rows("p3", {
    "carbs": f"CASE WHEN carbs > 250 THEN {FEWER} ELSE {HALF['carbs']} END",
    "sugar": f"CASE WHEN {SAVOURY} THEN {ROUND.format('carbs * 0.1::DOUBLE')} WHEN carbs > 250 AND sugar > {FEWER} THEN {ROUND.format(f'{FEWER} * CASE WHEN regexp_matches(n, {chr(39)}{repairs.SWEETS}{chr(39)}) THEN 0.55::DOUBLE ELSE 0.2::DOUBLE END')} ELSE {HALF['sugar']} END",
    **{c: HALF[c] for c in ("calories", "fat", "protein", "sodium")},
    "fiber": f"CASE WHEN fiber > 50 THEN least({ROUND.format('coalesce(calories, 500) * 0.01::DOUBLE')}, 15) ELSE {HALF['fiber']} END", "confidence_score": CAPPED}, "'extreme_values'")})),
kept AS (SELECT * FROM every WHERE after IS NOT NULL QUALIFY phase = min(phase) OVER (PARTITION BY nutrition_id))"""


@query("phased_repairs", PHASES + "SELECT nutrition_id, phase, field, before, after, reason FROM kept")
def phased_repairs(cat):
    wide = _wide(cat)
    found = fixes.phased(repairs.inflated_macros(wide), repairs.calorie_mismatch(wide), repairs.extreme_values(wide))
    return found.select("nutrition_id", "phase", "field", "before", "after", "reason")


@query("better_choices", SCORED + """, k AS (SELECT item_id, w.restaurant_id, score FROM scored JOIN (SELECT item_id, restaurant_id FROM wide) AS w USING (item_id))
SELECT a.item_id, CAST(row_number() OVER (PARTITION BY a.item_id ORDER BY b.score DESC, b.item_id) AS INT) AS "at", b.item_id AS choice, b.score
FROM k a JOIN k b ON a.restaurant_id = b.restaurant_id AND b.score > a.score QUALIFY "at" <= 2""")
def better_choices(cat):
    shown = browse.with_display(cat.wide)
    return repairs.better_choices(shown.select("item_id", "restaurant_id", F.col("score")))
