"""Fix records: (nutrition_id, field, before, after, reason), batching and applying.

Every imputer and repairer emits long fix rows.  A record's fixes fold into one
field map, and applying them is one join on the record key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.rules import present

FIELDS = (
    "calories", "carbs", "fat", "protein", "sugar", "fiber", "sodium", "cholesterol", "alcohol_grams", "confidence_score",
)


def emit(df: DataFrame, updates: Mapping[str, Column], reason: Column | str, when: Column | None = None) -> DataFrame:
    """Fix rows for every update column that is not null on a row where ``when`` holds."""
    rows = df if when is None else df.where(when)
    why = F.lit(reason) if isinstance(reason, str) else reason
    hits = [
        F.when(
            new.isNotNull(),
            F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("before"), new.cast("int").alias("after")),
        )
        for f, new in updates.items()
    ]
    return rows.select("item_id", "nutrition_id", why.alias("reason"), F.explode(present(*hits)).alias("x")).select(
        "item_id", "nutrition_id", "x.*", "reason"
    )


def capped_confidence(k: int) -> Column:
    """A repair never raises confidence: ``min(old or 50, k)``."""
    return F.least(F.coalesce("confidence_score", F.lit(50)), F.lit(k))


def phased(*phases: DataFrame, key: str = "nutrition_id") -> DataFrame:
    """Fixes of phases that all read the pre-fix values: the first phase to touch a record keeps it.

    The winning phase per record is an aggregate over keys only, joined back once.
    """
    out = None
    for number, phase in enumerate(phases, start=1):
        part = phase.withColumn("phase", F.lit(number))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(key).agg(F.min("phase").alias("phase"))
    return out.join(first, [key, "phase"], "left_semi")


def batch(fixes: DataFrame, order: str = "check_no") -> DataFrame:
    """One row per record: field map and how many fixes it got; of a field's fixes the one of the last check wins."""
    rank = F.struct(F.col(order), F.col("after"))
    last = fixes.groupBy("nutrition_id", "field").agg(F.max_by("after", rank).alias("after"), F.count(F.lit(1)).alias("n"))
    return last.groupBy("nutrition_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "after"))).alias("updates"), F.sum("n").alias("n_fixes")
    )


def apply_batch(table: DataFrame, batched: DataFrame, fields=FIELDS, stamp: Column | None = None) -> DataFrame:
    """New snapshot of ``table`` with the batched values, nulls among them; untouched rows keep theirs.

    ``stamp`` maintains an ``updated_at`` column on changed rows.
    """
    joined = table.join(batched.select("nutrition_id", "updates"), "nutrition_id", "left")
    out = joined.withColumns({
        f: F.when(F.map_contains_key("updates", F.lit(f)), F.try_element_at("updates", F.lit(f))).otherwise(F.col(f)).cast(table.schema[f].dataType)
        for f in fields if f in table.columns
    })
    if stamp is not None:
        old = F.col("updated_at") if "updated_at" in table.columns else F.col("created_at")
        out = out.withColumn("updated_at", F.when(F.col("updates").isNotNull(), stamp).otherwise(old))
    return out.drop("updates")


def mark_seasonal(items: DataFrame, closed: DataFrame) -> DataFrame:
    """Items of closed venues become seasonal."""
    hit = closed.select("restaurant_id").distinct().withColumn("_closed", F.lit(True))
    return items.join(hit, "restaurant_id", "left").withColumn(
        "is_seasonal", F.coalesce("_closed", F.lit(False)) | F.col("is_seasonal")
    ).drop("_closed")


def corrections(wide: DataFrame, table: DataFrame) -> DataFrame:
    """Literal correction table: ``name[, restaurant_name][, park_name]`` -> field values.

    Null restaurant or park means "anywhere"; an optional ``only_if_calories`` guards
    against correcting a row that was fixed before; null values leave a field alone.
    """
    t = table.select(*[F.col(c).alias(f"t_{c}") for c in table.columns])
    match = F.lower(wide["name"]) == F.lower(t["t_name"])
    for c in ("restaurant_name", "park_name"):
        if c in table.columns:
            match = match & (t[f"t_{c}"].isNull() | (t[f"t_{c}"] == wide[c]))
    if "only_if_calories" in table.columns:
        match = match & (t["t_only_if_calories"].isNull() | (t["t_only_if_calories"] == wide["calories"]))
    joined = wide.join(t, match)
    return emit(joined, {c: F.col(f"t_{c}") for c in table.columns if c in FIELDS}, "correction")
