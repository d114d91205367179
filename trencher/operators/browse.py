"""Browsing: composite filter, presets, sorts, paging, text lookup, summary figures."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.detect import display_category, section_header
from trencher.functions.rules import bound
from trencher.functions.scoring import grade, nutrition_score
from trencher.functions.text import display_name
from trencher.operators.dedupe import dedupe_items

PAGE = 48
SORTS = ("name", "carbsAsc", "carbsDesc", "caloriesAsc", "caloriesDesc", "grade")
GRADE_LETTERS = ("A", "B", "C", "D", "F")


@dataclass(frozen=True)
class FilterSpec:
    search: str = ""
    max_carbs: float | None = None
    category: str | None = None
    vegetarian_only: bool = False
    hide_fried: bool = False
    hide_drinks: bool = False
    hide_alcohol: bool = False
    grades: tuple[str, ...] = ()
    allergen_free: tuple[str, ...] = ()
    sort: str = "name"

    @classmethod
    def from_params(cls, params: dict[str, str]) -> FilterSpec:
        """Reads request parameters; anything malformed falls back to its default."""
        try:
            carbs = float(params["maxCarbs"])
            max_carbs = carbs if 0 <= carbs < float("inf") else None
        except (KeyError, ValueError):
            max_carbs = None
        grades = tuple(g for g in params.get("grade", "").split(",") if g in GRADE_LETTERS)
        free = tuple(v.strip() for v in params.get("allergenFree", "").split(",") if v.strip())
        sort = params.get("sort", "name")
        return cls(
            search=params.get("search", ""), max_carbs=max_carbs, category=params.get("category") or None,
            vegetarian_only=params.get("vegetarianOnly") == "true", hide_fried=params.get("hideFried") == "true",
            hide_drinks=params.get("hideDrinks") == "true", hide_alcohol=params.get("hideAlcohol") == "true",
            grades=grades, allergen_free=free, sort=sort if sort in SORTS else "name",
        )


PRESETS = {
    "low-carb": FilterSpec(max_carbs=30, sort="carbsAsc"),
    "top-rated": FilterSpec(grades=("A", "B"), sort="grade"),
    "gluten-free": FilterSpec(allergen_free=("wheat",)),
    "vegetarian": FilterSpec(vegetarian_only=True),
    "no-fried": FilterSpec(hide_fried=True, sort="grade"),
}


def with_display(wide: DataFrame) -> DataFrame:
    """Adds display name/category, score and grade."""
    rows = bound(wide, display_name=display_name(F.col("name")), score=nutrition_score())
    return bound(rows, display_category=display_category(), grade=grade(F.col("score")))


def apply_filters(wide: DataFrame, allergens: DataFrame, spec: FilterSpec) -> DataFrame:
    """Conjunction of the set options; unset ones add nothing to the plan.

    Unknown carbs and grades drop out, unknown alcohol stays.
    """
    df = wide.where(~section_header(F.col("name")))
    if spec.max_carbs is not None:
        df = df.where(F.col("carbs") <= spec.max_carbs)
    if spec.vegetarian_only:
        df = df.where("is_vegetarian")
    if spec.hide_fried:
        df = df.where("NOT is_fried")
    if spec.hide_alcohol:
        df = df.where(F.col("alcohol_grams").isNull() | (F.col("alcohol_grams") == 0))
    df = with_display(df)
    needle = spec.search.strip().lower()
    if needle:
        df = df.where(_mentions(needle, "display_name", "description", "restaurant_name"))
    if spec.category:
        df = df.where(F.col("display_category") == spec.category)
    if spec.hide_drinks:
        df = df.where(F.col("display_category") != "beverage")
    if spec.grades:
        df = df.where(F.col("grade").isin(*spec.grades))
    if spec.allergen_free:
        banned = allergens.where(F.lower("allergen_type").isin(*(a.lower() for a in spec.allergen_free)))
        df = df.join(banned.select("item_id"), "item_id", "left_anti")
    return df


def _mentions(needle: str, *columns: str) -> Column:
    tests = [F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False)) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def sort_keys(sort: str, tie: str = "item_id") -> list[Column]:
    """Nulls last in both directions; ``tie`` makes the order total."""
    keys = {
        "name": F.collate("display_name", "UNICODE").asc_nulls_last(),
        "carbsAsc": F.asc_nulls_last("carbs"),
        "carbsDesc": F.desc_nulls_last("carbs"),
        "caloriesAsc": F.asc_nulls_last("calories"),
        "caloriesDesc": F.desc_nulls_last("calories"),
        "grade": F.desc_nulls_last("score"),
    }
    return [keys.get(sort, keys["name"]), F.col(tie)]


def favourite_keys(sort: str, tie: str = "item_id") -> list[Column]:
    """Sorts of a saved list: unknown values get sentinels instead of going last."""
    keys = {
        "carbsAsc": F.coalesce("carbs", F.lit(999)).asc(),
        "carbsDesc": F.coalesce("carbs", F.lit(0)).desc(),
        "grade": F.coalesce("score", F.lit(-1)).desc(),
    }
    return [keys[sort], F.col(tie)] if sort in keys else [F.col(tie)]


def page(df: DataFrame, visible: int = PAGE, offset: int = 0) -> DataFrame:
    out = df.offset(max(0, offset)) if offset > 0 else df
    return out.limit(max(0, visible))


def next_visible(current: int, total: int, size: int = PAGE) -> int:
    return min(total, max(0, current) + size)


#: Hits that a text lookup shows.
LOOKUP_PAGE = 50


def text_lookup(wide: DataFrame, needle: str, park_id: int | None = None, size: int = LOOKUP_PAGE) -> DataFrame:
    """Case-insensitive substring lookup on name and description: all matches, headers dropped and copies merged, then a page of ``size`` by name.

    A literal ``contains`` needs no wildcard escaping.
    """
    df = wide.where(_mentions(needle.strip().lower(), "name", "description"))
    if park_id is not None:
        df = df.where(F.col("park_id") == park_id)
    best = dedupe_items(df.where(~section_header(F.col("name")))).select("item_id")
    return df.join(best, "item_id", "left_semi").orderBy("name", "item_id").limit(size)


def seasonal_only(wide: DataFrame) -> DataFrame:
    return wide.where("is_seasonal")


def top_picks(wide: DataFrame, k: int = 10) -> DataFrame:
    """Grades A and B, best score first."""
    return with_display(wide).where(F.col("grade").isin("A", "B")).orderBy(F.desc("score"), "item_id").limit(k)


def browse_summary(filtered: DataFrame, loaded: DataFrame, total: DataFrame, visible: int) -> DataFrame:
    """One row of listing figures; three independent counts glued as scalars."""
    f = filtered.agg(
        F.count(F.lit(1)).alias("filtered_count"), F.count_distinct("restaurant_id").alias("restaurant_count")
    ).withColumn("k", F.lit(1))
    n = loaded.agg(F.count(F.lit(1)).alias("loaded_count")).withColumn("k", F.lit(1))
    t = total.agg(F.count(F.lit(1)).alias("total_count")).withColumn("k", F.lit(1))
    return f.join(n, "k").join(t, "k").drop("k").select(
        "*",
        F.least(F.lit(visible), F.col("filtered_count")).alias("visible_count"),
        (F.col("total_count") > F.col("loaded_count")).alias("is_preview"),
        (F.col("filtered_count") > visible).alias("has_more"),
    )


def search_filters(spec: FilterSpec) -> FilterSpec:
    """The subset of options that applies on top of a fuzzy search."""
    return replace(
        FilterSpec(), max_carbs=spec.max_carbs, category=spec.category, grades=spec.grades,
        allergen_free=spec.allergen_free, sort=spec.sort,
    )


def best_in_row(items: DataFrame, group: str, order: str) -> DataFrame:
    """Winner per metric among the items compared with each other (first one wins ties)."""
    lower_wins = {"carbs": True, "net_carbs": True, "sugar": True, "fiber": False, "calories": True, "protein": False, "fat": True, "sodium": True}
    df = items.withColumn("net_carbs", F.greatest(F.lit(0), F.col("carbs") - F.col("fiber")))
    long = df.select(
        group, order, "item_id",
        F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in lower_wins)), F.array(*(F.col(m).cast("double") for m in lower_wins)))).alias("metric", "value"),
    ).where("value IS NOT NULL")
    lower = F.col("metric").isin(*(m for m, low in lower_wins.items() if low))
    rank = F.struct(F.when(lower, F.col("value")).otherwise(-F.col("value")), F.col(order), F.col("item_id"))
    return long.groupBy(group, "metric").agg(F.min_by(F.struct("item_id", "value"), rank).alias("b")).select(
        group, "metric", F.col("b.item_id").alias("best_item"), F.col("b.value").alias("best_value")
    )


