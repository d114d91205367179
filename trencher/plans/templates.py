"""Known nutrition profiles and their repair.

Some records are given a known profile, so that unlike dishes share one; both
engines read the same text.
"""

from __future__ import annotations

from trencher.functions.vocab import templates as V
from trencher.operators import templates
from trencher.plans.imputes import first_rule, lit
from trencher.plans.registry import query

GIVEN = (*V.REPLACED, *V.DEFAULTS)


def _given(column: str, at: int) -> str:
    """Every third item gets one of the profiles in turn, but every 33rd one gram of protein more."""
    more = " + CASE WHEN item_id % 33 = 0 THEN 1 ELSE 0 END" if column == "protein" else ""
    cases = " ".join(f"WHEN {i} THEN {row[at]}{more}" for i, row in enumerate(GIVEN))
    return f"CASE WHEN item_id % 3 = 0 THEN CASE CAST(floor(item_id / 3) AS INT) % {len(GIVEN)} {cases} END ELSE {column} END"


CHANGED = {c: _given(c, i) for i, c in enumerate(templates.MACROS)}


def _wide(cat):
    return cat.wide.selectExpr(*[f"CAST({CHANGED[c]} AS {cat.wide.schema[c].dataType.simpleString()}) AS {c}" if c in CHANGED else c for c in cat.wide.columns])


def _known(rows) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) k({', '.join(V.PROFILE_COLUMNS)})"


RAW = f", raw AS (SELECT * REPLACE ({', '.join(f'{sql} AS {c}' for c, sql in CHANGED.items())}) FROM wide)"


@query("default_profiles", RAW + f" SELECT item_id, profile FROM raw JOIN {_known(V.DEFAULTS)} USING (calories, carbs, fat, protein)")
def default_profiles(cat):
    return templates.with_profile(_wide(cat), templates.profiles(cat.spark, V.DEFAULTS)).select("item_id", "profile")


SHARES = tuple(f"t_{c}" for c in V.DISH_COLUMNS)
_grams = lambda share, per: f"CAST(floor(t_calories * t_{share} / {per}::DOUBLE + 0.5::DOUBLE) AS INT)"
NEW = {
    "calories": "t_calories", "carbs": _grams("carb_share", 4), "fat": _grams("fat_share", 9), "protein": _grams("protein_share", 4),
    "sugar": f"CAST(floor({_grams('carb_share', 4)} * t_sugar_share + 0.5::DOUBLE) AS INT)", "fiber": "t_fiber", "sodium": "t_sodium", "cholesterol": "t_cholesterol", "confidence_score": str(V.CONFIDENCE),
}


@query("replaced_profiles", RAW + f", src AS (SELECT * FROM raw JOIN {_known(V.REPLACED)} USING (calories, carbs, fat, protein) WHERE nutrition_id IS NOT NULL)" + first_rule("di", "src", V.DISHES, SHARES, "lower(name)")
       + ", j AS (SELECT * FROM src JOIN di ON lower(name) = tx AND category IS NOT DISTINCT FROM ct) "
       + " UNION ALL ".join(f"SELECT item_id, '{f}' AS field, CAST({f} AS INT) AS before, CAST({sql} AS INT) AS after, profile AS reason FROM j" for f, sql in NEW.items()))
def replaced_profiles(cat):
    return templates.replaced_profiles(_wide(cat), templates.profiles(cat.spark)).select("item_id", "field", "before", "after", "reason")
