"""Records that hold a known nutrition profile, and their repair by kind of dish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.functions.numeric import round_half_up
from trencher.functions.rules import RuleTable, bound
from trencher.functions.vocab import templates as V
from trencher.operators.fixes import emit

MACROS = ("calories", "carbs", "fat", "protein")
DISH_TABLE = RuleTable(V.DISHES, V.DISH_COLUMNS)


def profiles(spark, rows=V.REPLACED) -> DataFrame:
    return spark.createDataFrame(list(rows), "calories int, carbs int, fat int, protein int, profile string")


def with_profile(wide: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``wide`` whose four macros are those of a row of ``known``, with its ``profile``.

    One equi-join on all four values: whether ``known`` is broadcast is left to its
    size, and a profile that most rows hold splits as any skewed key does.  A null
    macro equals nothing; of equal profiles the first by name counts.
    """
    first = known.groupBy(*MACROS).agg(F.min("profile").alias("profile"))
    return wide.join(first, list(MACROS))


def replaced_profiles(wide: DataFrame, known: DataFrame) -> DataFrame:
    """Fix rows that put an estimate by kind of dish in place of a known profile.

    The first kind whose pattern the name holds counts; a row of no kind, or
    without a name, keeps its values.
    """
    rows = bound(with_profile(wide.where("nutrition_id IS NOT NULL"), known), dish_no=DISH_TABLE.first(F.lower("name"))).where("dish_no IS NOT NULL")
    new = {c: DISH_TABLE.output(F.col("dish_no"), c) for c in V.DISH_COLUMNS}
    grams = lambda share, per: round_half_up(new["calories"] * new[share] / F.lit(per))
    carbs = grams("carb_share", 4.0)
    return emit(rows, {
        "calories": new["calories"], "carbs": carbs, "fat": grams("fat_share", 9.0), "protein": grams("protein_share", 4.0), "sugar": round_half_up(carbs * new["sugar_share"]),
        "fiber": new["fiber"], "sodium": new["sodium"], "cholesterol": new["cholesterol"], "confidence_score": F.lit(V.CONFIDENCE),
    }, F.col("profile"))
