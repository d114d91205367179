"""Location hierarchy and per-place counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions import taxonomy
from trencher.functions.detect import canonical_park_name, park_location, park_timezone
from trencher.functions.text import canonical_key, clean_display, file_slug, slug

LEVELS = ("resort", "category", "venue", "area", "restaurant")


def _venue_name(park: Column, key: Column) -> Column:
    cleaned = clean_display(park)
    return (
        F.when(park.isNull(), "Unknown Destination")
        .when(key == "universal epic universe", "Universal Epic Universe")
        .when(key == "universal volcano bay", "Universal Volcano Bay")
        .when(cleaned == "", park)
        .otherwise(cleaned)
    )


def location_keys(wide: DataFrame) -> DataFrame:
    """Adds the five levels (id, name) and their sort positions to every item."""
    park = F.col("park_name")
    where = taxonomy.classify(park, {
        "resort_id": "other", "resort_name": "Other Destinations", "resort_no": len(taxonomy.TAXONOMY),
        "category_id": "destinations", "category_label": "Destinations", "category_no": 0,
    })
    df = wide.withColumns({**where, "park_key": canonical_key(park)})
    df = df.withColumns({
        "venue_name": _venue_name(park, F.col("park_key")),
        "venue_no": taxonomy.venue_position(park, F.col("resort_id"), F.col("category_id")),
        "area_name": F.coalesce(F.nullif(F.trim("land"), F.lit("")), F.lit("Dining Locations")),
        "place_name": F.coalesce(F.nullif(F.trim("restaurant_name"), F.lit("")), F.lit("Unknown Restaurant")),
    })
    df = df.withColumn(
        "venue_id", F.concat(F.lit("venue-"), slug(F.coalesce(F.when(park.isNotNull(), F.col("park_key")), F.col("venue_name"))))
    )
    df = df.withColumn("area_id", F.concat("venue_id", F.lit(":"), slug(F.col("area_name"))))
    return df.withColumn(
        "place_id",
        F.coalesce(F.col("restaurant_id").cast("string"), F.concat("area_id", F.lit(":"), slug(F.col("place_name")))),
    )


def location_counts(wide: DataFrame) -> DataFrame:
    """Item counts at every level of the hierarchy: one row per node.

    Items are first counted per place; only those few rows are named, classified
    and put through the five-level rollup, so neither the text work nor the
    rollup's row expansion touches items.
    """
    leaf_keys = ("resort_no", "resort_id", "resort_name", "category_no", "category_id", "category_label",
                 "venue_id", "area_id", "place_id")
    places = wide.groupBy("park_name", "land", "restaurant_id", "restaurant_name").agg(F.count(F.lit(1)).alias("n"))
    leaves = location_keys(places).groupBy(*leaf_keys).agg(
        F.sum("n").alias("n"), F.min("venue_no").alias("venue_no"), F.min("venue_name").alias("venue_name"),
        F.min("area_name").alias("area_name"), F.min("place_name").alias("place_name"),
    )
    resort = F.struct("resort_no", "resort_id", "resort_name").alias("resort")
    category = F.struct("category_no", "category_id", "category_label").alias("category")
    rolled = leaves.select(resort, category, "venue_id", "area_id", "place_id", "n", "venue_no", "venue_name", "area_name", "place_name").rollup(
        "resort", "category", "venue_id", "area_id", "place_id"
    ).agg(
        F.grouping_id().alias("gid"), F.sum("n").alias("item_count"), F.min("venue_no").alias("venue_no"),
        F.min("venue_name").alias("venue_name"), F.min("area_name").alias("area_name"), F.min("place_name").alias("place_name"),
    ).where("gid <> 31")
    level = F.try_element_at(F.create_map(*(F.lit(x) for p in {15: 1, 7: 2, 3: 3, 1: 4, 0: 5}.items() for x in p)), F.col("gid").cast("int"))
    at = lambda n, c: F.when(F.col("level") >= n, F.col(c))
    return rolled.withColumn("level", level).select(
        "level", F.col("resort.resort_id").alias("resort_id"), F.col("resort.resort_name").alias("resort_name"),
        F.col("category.category_id").alias("category_id"), F.col("category.category_label").alias("category_label"),
        "venue_id", at(3, "venue_name").alias("venue_name"), "area_id", at(4, "area_name").alias("area_name"),
        "place_id", at(5, "place_name").alias("place_name"), "item_count",
        F.col("resort.resort_no").alias("resort_no"), F.col("category.category_no").alias("category_no"), at(3, "venue_no").alias("venue_no"),
    )


def ordered_nodes(counts: DataFrame) -> DataFrame:
    """Nodes in display order: configured positions first, then names."""
    name = lambda c: F.collate(F.coalesce(F.col(c), F.lit("")), "UNICODE")
    first = lambda c: F.asc_nulls_first(c)
    return counts.orderBy(
        "resort_no", name("resort_name"), first("category_no"), name("category_label"), first("venue_no"),
        name("venue_name"), first("venue_id"), name("area_name"), first("area_id"), name("place_name"), first("place_id"),
    )


def items_per_park(parks_of: DataFrame, items: DataFrame) -> DataFrame:
    """Counts per park; parks whose restaurants have no items count 0, orphans are ignored.

    Counting per restaurant before the join keeps a hot park from skewing it.
    """
    per_place = items.where("restaurant_id IS NOT NULL").groupBy("restaurant_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        parks_of.where("park_id IS NOT NULL")
        .join(per_place, "restaurant_id", "left")
        .groupBy("park_id")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("item_count"))
    )


def home_groups(parks: DataFrame, counts: DataFrame) -> DataFrame:
    """Parks under resort and category with counts; parks known to be empty are
    dropped, but only when some park has items."""
    where = taxonomy.classify(F.col("park_name"), {
        "resort_id": "other", "resort_name": "Supplemental Dining", "resort_location": "Additional theme-park dining records",
        "category_id": "destinations", "category_label": "Additional Locations",
    })
    any_items = counts.agg(F.coalesce(F.max(F.col("item_count") > 0), F.lit(False)).alias("any_items")).withColumn("_one", F.lit(1))
    known = parks.join(counts, "park_id", "left").withColumn("_one", F.lit(1)).join(any_items, "_one").where(
        ~F.col("any_items") | F.col("item_count").isNull() | (F.col("item_count") > 0)
    )
    return known.withColumns(where).select(
        *where, "park_id", "park_name", F.coalesce("item_count", F.lit(0)).alias("item_count"),
        taxonomy.venue_position(F.col("park_name"), F.col("resort_id"), F.col("category_id")).alias("venue_no"),
    )


def home_totals(groups: DataFrame) -> DataFrame:
    return groups.groupBy("resort_id", "category_id").agg(
        F.sum("item_count").alias("item_count"), F.count(F.lit(1)).alias("location_count")
    )


def category_counts(parks: DataFrame, counts: DataFrame) -> DataFrame:
    """Items per resort category.  A park counts in every category one of whose
    patterns it matches; seasonal categories show 0."""
    rows = taxonomy.flat_patterns()
    seen, tests = set(), []
    for r in rows:
        key = (r["resort_id"], r["category_id"])
        if key in seen:
            continue
        seen.add(key)
        mine = [x["pattern"] for x in rows if (x["resort_id"], x["category_id"]) == key]
        hit = F.lit(False)
        for p in mine:
            hit = hit | F.contains(F.lower("park_name"), F.lit(p))
        tests.append(F.when(hit & ~F.lit(r["seasonal"]), F.struct(F.lit(key[0]).alias("resort_id"), F.lit(key[1]).alias("category_id"))))
    hits = parks.join(counts, "park_id").select("item_count", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("c"))
    return hits.groupBy("c.resort_id", "c.category_id").agg(F.sum("item_count").alias("item_count"))


def group_sizes(wide: DataFrame) -> DataFrame:
    """Listing sections: by land (unknown land is "Other Areas") and by restaurant."""
    land = F.coalesce(F.nullif(F.col("land"), F.lit("")), F.lit("Other Areas"))
    return wide.groupBy("park_id", land.alias("land"), "restaurant_id").agg(F.count(F.lit(1)).alias("item_count"))


def catalogue_preview(rows: DataFrame) -> DataFrame:
    """Per displayed park: items, distinct (land, restaurant) pairs, sorted lands.

    ``rows``: park_name, land, restaurant_name, one per item.  Two stages, so the
    distinct counts run over pre-grouped pairs.
    """
    named = rows.withColumn("name", canonical_park_name(F.col("park_name")))
    pairs = named.groupBy("name", "land", "restaurant_name").agg(F.count(F.lit(1)).alias("n"))
    per_park = pairs.groupBy("name").agg(
        F.sum("n").alias("item_count"),
        F.count(F.when(F.coalesce("restaurant_name", F.lit("")) != "", 1)).alias("restaurant_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("land") != "", F.col("land")))), "|").alias("lands"),
    )
    where = taxonomy.classify(F.col("name"), {"resort_id": "other", "category_id": "destinations"})
    return per_park.withColumns(where).select(
        file_slug(F.col("name")).alias("id"), "name", park_location(F.col("name")).alias("location"),
        park_timezone(F.col("name")).alias("timezone"), "resort_id", "category_id", "item_count", "restaurant_count", "lands",
    )


def preview_totals(preview: DataFrame) -> DataFrame:
    return preview.agg(
        F.sum("item_count").alias("total_items"), F.sum("restaurant_count").alias("total_restaurants"),
        F.count(F.lit(1)).alias("total_destinations"),
    )


def with_as_of(counts: DataFrame, as_of: Column) -> DataFrame:
    """A materialised count table carries the time it was taken; see :func:`fresh`."""
    return counts.withColumn("as_of", as_of)


def fresh(counts: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return counts.where(F.col("as_of") > now - F.make_dt_interval(F.lit(days)))
