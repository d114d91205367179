"""Dose scoring over readings: each line of an order is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from trencher.functions.dosing import score_doses
from trencher.plans.registry import query

_E = "CAST(floor(l_extendedprice) AS INT)"
READING = {
    "carbs": f"CASE WHEN {_E} % 41 = 0 THEN NULL ELSE CAST({_E} % 263 AS DOUBLE) END",
    "blood_glucose": f"CASE WHEN {_E} % 43 = 0 THEN NULL ELSE CAST(35 + {_E} % 371 AS DOUBLE) END",
    "target": f"CASE WHEN {_E} % 47 = 0 THEN NULL ELSE CAST(70 + {_E} % 103 AS DOUBLE) END",
    "icr": f"CASE WHEN {_E} % 53 = 0 THEN NULL ELSE CAST(3 + {_E} % 29 AS DOUBLE) END",
    "cf": f"CASE WHEN {_E} % 59 = 0 THEN NULL ELSE CAST(10 + {_E} % 97 AS DOUBLE) END",
    "activity": f"CASE {_E} % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'mod' ELSE 'high' END",
    "active_insulin": f"CASE WHEN {_E} % 2 = 0 THEN NULL ELSE CAST({_E} % 7 AS DOUBLE) END",
    "max_bolus": f"CASE WHEN {_E} % 5 = 0 THEN CAST({_E} % 61 AS DOUBLE) ELSE NULL END",
}
KEYS = {"order_id": "l_orderkey", "line": "l_linenumber", "item_id": "l_partkey", "restaurant_id": "l_suppkey"}


@query("dose_scores", f"""WITH r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in (KEYS | READING).items())} FROM lineitem),
c AS (SELECT *, coalesce(active_insulin, 0) AS board, coalesce(max_bolus, 25) AS cap, coalesce(blood_glucose BETWEEN 40 AND 69, false) AS low,
  carbs IS NULL OR blood_glucose IS NULL OR target IS NULL OR icr IS NULL OR cf IS NULL AS incomplete FROM r),
v AS (SELECT *, CASE WHEN low THEN 'hypoglycemia' WHEN incomplete THEN 'incomplete'
  WHEN carbs BETWEEN 0 AND 250 AND blood_glucose BETWEEN 40 AND 600 AND target BETWEEN 70 AND 180 AND icr BETWEEN 3 AND 30 AND cf BETWEEN 10 AND 150
    AND board BETWEEN 0 AND 50 AND cap BETWEEN 1 AND 50 THEN 'valid' ELSE 'invalid' END AS validation FROM c),
d AS (SELECT *, greatest(0, (blood_glucose - target) / cf) AS correction FROM v WHERE validation = 'valid'),
t AS (SELECT *, greatest(0, carbs / icr * (1 - CASE activity WHEN 'mod' THEN 0.25::DOUBLE WHEN 'high' THEN 0.5::DOUBLE ELSE 0 END) + greatest(0, correction - least(board, correction))) AS total FROM d)
SELECT order_id, line, item_id, restaurant_id, validation, blood_glucose IS NOT NULL AND blood_glucose < 70 AS low_glucose, blood_glucose IS NOT NULL AND blood_glucose < 54 AS urgent_low,
  CASE WHEN total > least(cap, 50) THEN 'blocked' WHEN total > 15 THEN 'warning' WHEN total IS NOT NULL THEN 'ok' END AS dose_status,
  CASE WHEN total <= least(cap, 50) THEN floor(total * 10 + 0.5::DOUBLE) / 10 END AS suggested
FROM (SELECT *, CAST(NULL AS DOUBLE) AS total FROM v WHERE validation <> 'valid' UNION ALL BY NAME SELECT * EXCLUDE (correction) FROM t)""", base=False)
def dose_scores(cat):
    readings = cat.table("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in (KEYS | READING).items()]).withColumn("blocked_by_nutrition", F.lit(False))
    return score_doses(readings).select(*KEYS, "validation", "low_glucose", "urgent_low", "dose_status", "suggested")
