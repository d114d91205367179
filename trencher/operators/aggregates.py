"""Catalogue statistics: coverage, duplicates, outliers, gaps, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trencher.functions.numeric import missing
from trencher.functions.text import edges

PROFILE = ("calories", "carbs", "fat", "protein", "sugar", "sodium")
ENERGY_PROFILE = ("calories", "carbs", "fat", "protein")

# Drinks that share nutrition by nature.
GENERIC_DRINKS = (
    r"^(draft |bottled |canned )?(beer|ale|lager|wine|prosecco|champagne|soda|pop|water|juice|milk|coffee|tea|iced tea|lemonade)s?$"
    r"|^(domestic|imported|craft|premium|house) (beer|wine|red|white)s?$"
    r"|^(coca.cola|pepsi|sprite|dr.pepper|fanta|mountain dew|dasani|aquafina|smartwater|powerade|gatorade|minute maid|tropicana)"
)
# Chains and whether official nutrition exists for them.
CHAINS = (
    ("starbucks", "Starbucks", True), ("jamba", "Jamba", True), ("wetzel", "Wetzel's Pretzels", True),
    ("auntie anne", "Auntie Anne's", True), ("cinnabon", "Cinnabon", True), ("blaze pizza", "Blaze Pizza", True),
    ("chicken guy", "Chicken Guy!", True), ("panda express", "Panda Express", True), ("cold stone", "Cold Stone Creamery", True),
    ("haagen.daz", "Häagen-Dazs", True), ("ben.jerry", "Ben & Jerry's", True), ("moe.*southwest", "Moe's Southwest Grill", True),
    ("voodoo dough", "Voodoo Doughnut", True), ("sprinkles", "Sprinkles", True), ("planet hollywood", "Planet Hollywood", False),
    ("rainforest cafe", "Rainforest Cafe", False), ("t-rex", "T-REX", False), ("ghirardelli", "Ghirardelli", True),
    ("skyline chili", "Skyline Chili", True), ("larosa", "LaRosa's Pizza", True), ("dippin.dots", "Dippin' Dots", True),
    ("subway", "Subway", True),
)


def same_values(columns) -> Column:
    """Null-safe equality of ``l.c`` and ``r.c`` for every column."""
    return reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns))


def shared_profiles(wide: DataFrame, at_least: int = 3, above: int = 10) -> DataFrame:
    """Restaurants where several items carry one nutrition profile."""
    usable = wide.where(F.col("calories").isNotNull() & (F.col("calories") != 0))
    groups = usable.groupBy("restaurant_id", *PROFILE).agg(
        F.count(F.lit(1)).alias("items"),
        F.size(F.collect_set("category")).alias("categories"),  # a closed set of five
        F.min_by(F.struct("park_name", "source", "confidence_score"), "item_id").alias("f"),
    )
    return groups.where((F.col("items") >= at_least) & (F.col("calories") > above)).select(
        "restaurant_id", *PROFILE, "items", "categories", "f.*"
    )


def shared_profile_rollups(groups: DataFrame) -> DataFrame:
    """Totals by park, source and confidence in one pass over the (small) groups."""
    sets = groups.groupingSets(
        [["park_name"], ["source"], ["confidence_score"], []], "park_name", "source", "confidence_score"
    ).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("groups"), F.sum("items").alias("items"),
        F.sum(F.when(F.col("categories") >= 3, F.col("items")).otherwise(0)).alias("mixed_category"),
        F.sum(F.when(F.col("confidence_score") >= 60, F.col("items")).otherwise(0)).alias("high_confidence"),
        F.sum(F.when(F.coalesce("confidence_score", F.lit(0)) <= 40, F.col("items")).otherwise(0)).alias("low_confidence"),
    )
    key = (
        F.when(F.col("gid") == 3, F.col("park_name")).when(F.col("gid") == 5, F.col("source"))
        .when(F.col("gid") == 6, F.col("confidence_score").cast("string"))
    )
    kind = F.when(F.col("gid") == 3, "park").when(F.col("gid") == 5, "source").when(F.col("gid") == 6, "confidence").otherwise("total")
    return sets.select(kind.alias("kind"), key.alias("key"), "groups", "items", "mixed_category", "high_confidence", "low_confidence")


def _by_profile(rows: DataFrame, keys: tuple[str, ...], label: Column) -> DataFrame:
    """Per key: rows, distinct labels and first item, distinct counted by pre-grouping."""
    inner = rows.groupBy(*keys, label.alias("_label")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item"))
    return inner.groupBy(*keys).agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("labels"), F.min("first_item").alias("first_item")
    )


def global_profiles(wide: DataFrame) -> DataFrame:
    """Different items anywhere that share all six values; flagged once, on the first item."""
    rows = wide.where(F.col("calories").isNotNull() & (F.col("calories") != 0))
    label = F.regexp_replace(F.lower("name"), "[^a-z]", "")
    return _by_profile(rows, PROFILE, label).where("items >= 2 AND labels > 1").withColumn(
        "severity", F.when(F.col("items") > 3, "HIGH").otherwise("MEDIUM")
    )


def _flag_members(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    out = rows.alias("l").join(groups.alias("r"), same_values(keys)).select("l.*", (F.col("r.items") - 1).alias("others"))
    return out


def shared_energy_profiles(wide: DataFrame) -> DataFrame:
    """Every item whose four energy values are shared by three or more dissimilar items."""
    generic = (F.col("category") == "beverage") & F.lower(F.trim("name")).rlike(edges(GENERIC_DRINKS))
    rows = wide.where(F.col("calories").isNotNull() & (F.col("calories") != 0) & ~generic)
    name = F.trim(F.regexp_replace(F.lower("name"), r"customized bowl:?\s*", ""))
    groups = _by_profile(rows, ENERGY_PROFILE, F.substring_index(name, " ", 3)).where("items >= 3 AND labels > 2")
    return _flag_members(rows, groups, ENERGY_PROFILE)


def restaurant_profiles(wide: DataFrame) -> DataFrame:
    """Differently named items of one restaurant name with equal energy values."""
    keys = ("restaurant_name", *ENERGY_PROFILE)
    rows = wide.where("calories > 0")
    groups = _by_profile(rows, keys, F.col("name")).where("items >= 2 AND labels >= 2")
    return _flag_members(rows, groups, keys)


def duplicate_names(items: DataFrame) -> DataFrame:
    return items.groupBy("restaurant_id", F.lower(F.trim("name")).alias("name_key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("item_id").alias("first_item")
    ).where("copies > 1")


def duplicate_parks(parks: DataFrame, key: Column) -> DataFrame:
    return parks.groupBy(key.alias("park_key")).agg(
        F.count(F.lit(1)).alias("copies"), F.min("park_id").alias("first_park")
    ).where("copies > 1")


def missing_by_park(wide: DataFrame) -> DataFrame:
    """Null-only rates, with savoury items lacking protein; parks with something to report."""
    savoury_zero = (F.col("protein") == 0) & (F.col("calories") > 200) & ~F.col("category").isin("dessert", "beverage")
    stats = wide.groupBy(F.coalesce("park_name", F.lit("Unknown")).alias("park")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("calories").isNull()).alias("missing_nutrition"),
        F.count_if(F.col("sodium").isNull()).alias("missing_sodium"), F.count_if(F.col("sugar").isNull()).alias("missing_sugar"),
        F.count_if(savoury_zero).alias("zero_protein"), F.count_if(F.col("price").isNull()).alias("missing_price"),
    )
    return stats.where(
        "missing_nutrition > 0 OR missing_sodium > total * 0.3D OR missing_sugar > total * 0.3D OR zero_protein > 3"
    )


def gaps_by_park(wide: DataFrame, over: int = 30) -> DataFrame:
    """Null-or-zero percentages among items with a record; parks above ``over`` percent."""
    fields = ("sodium", "sugar", "protein")
    stats = wide.where("nutrition_id IS NOT NULL").groupBy(F.coalesce("park_name", F.lit("Unknown")).alias("park")).agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(missing(F.col(f))).alias(f) for f in fields)
    )
    pct = [F.floor(F.col(f) / F.col("total") * 100 + 0.5).alias(f"{f}_missing_pct") for f in fields]
    return stats.select("park", "total", *pct).where(" OR ".join(f"{f}_missing_pct > {over}" for f in fields))


def coverage(nutrition: DataFrame) -> DataFrame:
    """One pass: how many records know each value."""
    known = ("carbs", "protein", "fat", "sugar", "fiber", "sodium")
    return nutrition.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("calories") > 0).alias("with_calories"),
        *(F.count(c).alias(f"with_{c}") for c in known),
    )


def confidence_bucket() -> Column:
    c = F.col("confidence_score")
    return (
        F.when(c.isNull(), "null").when(c >= 70, "70+").when(c >= 50, "50-69").when(c >= 40, "40-49")
        .when(c >= 30, "30-39").otherwise("<30")
    )


def source_and_confidence(nutrition: DataFrame) -> DataFrame:
    return nutrition.groupBy(F.coalesce("source", F.lit("unknown")).alias("source"), confidence_bucket().alias("bucket")).agg(
        F.count(F.lit(1)).alias("records")
    )


def gap_reasons(wide: DataFrame) -> DataFrame:
    """Why a value is still missing, by category."""
    has_energy = F.col("calories") > 0
    reason = lambda test, text: F.when(test, F.lit(text))
    reasons = F.array(
        reason(has_energy & missing(F.col("sugar")) & missing(F.col("carbs")), "sugar: no carbs data"),
        reason(has_energy & missing(F.col("sugar")) & (F.col("carbs") > 0), "sugar: has carbs but no sugar estimate"),
        reason(has_energy & missing(F.col("protein")), "protein"),
        reason((F.col("carbs") > 0) & missing(F.col("fiber")), "fiber"),
        reason(has_energy & missing(F.col("sodium")), "sodium"),
    )
    return wide.select("category", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason")).groupBy(
        "reason", "category"
    ).agg(F.count(F.lit(1)).alias("items"))


def allergen_counts(allergens: DataFrame) -> DataFrame:
    """Per type: total and by severity."""
    return allergens.groupBy("allergen_type").pivot("severity", ["contains", "may_contain"]).count().na.fill(0).select(
        "allergen_type", "contains", "may_contain", (F.col("contains") + F.col("may_contain")).alias("total")
    )


def allergens_per_item(allergens: DataFrame) -> DataFrame:
    return allergens.groupBy("item_id").count().groupBy(F.col("count").alias("n_allergens")).agg(F.count(F.lit(1)).alias("items"))


def chain_coverage(wide: DataFrame, restaurants: DataFrame, chains=CHAINS) -> DataFrame:
    """Locations, items and upgradeable (confidence < 70) items per chain.

    Items are counted per restaurant first; a name may belong to several chains.
    """
    per_place = wide.groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("confidence_score") < 70).alias("low")
    )
    name = F.lower("restaurant_name")
    hits = F.array(*(
        F.when(name.rlike(edges(p)), F.struct(F.lit(label).alias("chain"), F.lit(official).alias("has_official")))
        for p, label, official in chains
    ))
    tagged = restaurants.select("restaurant_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return tagged.join(per_place, "restaurant_id", "left").groupBy("h.chain", "h.has_official").agg(
        F.count(F.lit(1)).alias("locations"), F.sum(F.coalesce("items", F.lit(0))).alias("items"),
        F.sum(F.coalesce("low", F.lit(0))).alias("upgradeable"),
    )


def sigma_outliers(wide: DataFrame, sigmas: float = 3.0, at_least: int = 10) -> DataFrame:
    """Items more than ``sigmas`` population deviations from their category's mean of positive calories."""
    known = wide.where("calories IS NOT NULL").withColumn("category", F.coalesce("category", F.lit("unknown")))
    positive = F.when(F.col("calories") > 0, F.col("calories"))
    stats = known.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(positive).alias("mean"), F.stddev_pop(positive).alias("sd")
    ).where(F.col("n") >= at_least)
    return known.where("calories > 0").join(stats, "category").where(
        F.abs(F.col("calories") - F.col("mean")) > sigmas * F.col("sd")
    )


def index_quartiles(wide: DataFrame, at_least: int = 5) -> DataFrame:
    """Median and quartiles by position ``floor(f * n)`` on the descending calorie list.

    Exact at any size: categories are reduced to (category, calories, count) first,
    and the running count only walks the distinct calorie values.
    """
    hist = wide.where(F.col("calories").isNotNull() & (F.col("calories") != 0)).groupBy("category", "calories").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("category").orderBy(F.desc("calories"))
    upto = hist.withColumn("upto", F.sum("c").over(down)).withColumn("n", F.sum("c").over(Window.partitionBy("category")))

    def at(fraction: float) -> Column:
        spot = F.floor(F.col("n") * F.lit(fraction))
        return F.max(F.when((F.col("upto") > spot) & (F.col("upto") - F.col("c") <= spot), F.col("calories")))

    return upto.groupBy("category").agg(F.max("n").alias("n"), at(0.75).alias("q1"), at(0.5).alias("median"), at(0.25).alias("q3")).where(F.col("n") >= at_least)


def quartile_outliers(wide: DataFrame) -> DataFrame:
    """Foods under 10 calories that lie beyond two quartile ranges."""
    q = index_quartiles(wide)
    iqr = F.col("q3") - F.col("q1")
    rows = wide.where((F.col("calories") != 0) & (F.col("calories") < 10) & (F.col("category") != "beverage"))
    return rows.join(q, "category").where(
        (F.col("calories") > F.col("q3") + 2 * iqr) | (F.col("calories") < F.col("q1") - 2 * iqr)
    )


def ranking_violations(wide: DataFrame) -> DataFrame:
    """Water, tea and black coffee among the top 20 drinks; plain salads among the top 30 entrées.

    The rank filter sits on the window itself, so Spark keeps only the top rows of
    each map task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("calories"), "item_id"))
    top = wide.where(F.col("calories").isNotNull() & F.col("category").isin("beverage", "entree")).withColumn("rank", rank).where("rank <= 30")
    name = F.lower("name")
    drink = (F.col("category") == "beverage") & (F.col("rank") <= 20) & (F.col("calories") > 100) & name.rlike(edges(
        "^(water|unsweetened.*tea|hot tea|brewed coffee|black coffee)"
    ))
    salad = (F.col("category") == "entree") & (F.col("calories") > 1000) & name.rlike(edges(r"\bsalad\b")) & ~name.rlike("loaded|crispy|fried|taco")
    return top.where(drink | salad).withColumn("severity", F.when(drink, "HIGH").otherwise("MEDIUM"))


# Histogram edges in grams.
ALCOHOL_BINS = (0, 1, 8, 12, 15, 20, 25, 30, 50)


def histogram(df: DataFrame, column: str, edges=ALCOHOL_BINS) -> DataFrame:
    """Counts per ``[edge, next)`` bin, the last one open; empty bins are not listed."""
    c = F.col(column)
    bin_ = F.when(c.isNull() | (c < edges[0]), F.lit(None).cast("int"))
    for low, high in zip(edges, edges[1:]):
        bin_ = bin_.when(c < high, low)
    return df.select(bin_.otherwise(edges[-1]).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
