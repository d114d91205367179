"""Scraped menus and photos resolved to the catalogue's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trencher.functions.text import match_name, spaced_name
from trencher.functions.vocab.matching import FOOD_KEYWORDS, KEYWORD_LENGTH, PHOTO_WORD_LENGTH, STOP_WORDS
from trencher.operators import matching
from trencher.operators.components import roots
from trencher.operators.storage import stored

# The scores from which names match.
RESTAURANT_FLOOR, ITEM_FLOOR = 70, 75
RESTAURANT_ABOVE, ITEM_ABOVE, PARK_ABOVE, SURE = 0.7, 0.75, 0.85, 0.9
PHOTO_WORDS, PHOTO_SCORE = 2, 0.6
NEIGHBOURS, LEAST_SIMILARITY, LEAST_POOL, CONFIDENCE_SHARE, LEAST_CONFIDENCE = 3, 50, 5, 0.8, 50
ALWAYS, ALL_OR_NONE = ("calories", "carbs", "fat", "protein"), ("sugar", "fiber", "sodium")


def _have(c: str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.col(c) != "", F.lit(False))


# --- two levels by fuzzy score --------------------------------------------------------

def match_menus(scraped: DataFrame, parks: DataFrame, restaurants: DataFrame, items: DataFrame) -> DataFrame:
    """``dish_id, restaurant_id, restaurant_score, item_id, item_score, status`` for every scraped dish.

    ``scraped``: ``dish_id, park, restaurant, name``.  Its park is every park
    whose name holds it, whatever the case; its restaurant the best of those
    parks from ``RESTAURANT_FLOOR`` on; its item the best of that restaurant from
    ``ITEM_FLOOR`` on, ties to the least id.  A dish with an item is ``updated``,
    any other is ``new``; null parks and names match nothing.
    """
    given = scraped.select("dish_id", F.lower("park").alias("park_"), match_name(F.col("restaurant")).alias("restaurant_"), match_name(F.col("name")).alias("name_"))
    given = stored(given, "dishes")
    of_park = matching.within(given.select(F.col("park_").alias("name")).where("name IS NOT NULL"), parks.select(F.col("park_id").alias("id"), F.col("park_name").alias("name")))
    there = restaurants.join(of_park.withColumnRenamed("id", "park_id"), "park_id").select(
        F.col("asked").alias("block"), match_name(F.col("restaurant_name")).alias("name"), F.col("restaurant_id").alias("id"))
    place = matching.fuzzy_best(given.select(F.col("park_").alias("block"), F.col("restaurant_").alias("name")), there, RESTAURANT_FLOOR)
    place = stored(place.toDF("park_", "restaurant_", "restaurant_id", "restaurant_score"), "restaurants")
    placed = stored(given.join(place, ["park_", "restaurant_"], "left"), "placed")
    menu = items.select(F.col("restaurant_id").alias("block"), match_name(F.col("name")).alias("name"), F.col("item_id").alias("id"))
    dish = matching.fuzzy_best(placed.select(F.col("restaurant_id").alias("block"), F.col("name_").alias("name")), menu, ITEM_FLOOR)
    found = placed.join(dish.toDF("restaurant_id", "name_", "item_id", "item_score"), ["restaurant_id", "name_"], "left")
    return found.select("dish_id", "restaurant_id", "restaurant_score", "item_id", "item_score", F.when(F.col("item_id").isNull(), "new").otherwise("updated").alias("status"))


# --- two stages by edit distance -------------------------------------------------------

def enrich_from_menus(scraped: DataFrame, wide: DataFrame) -> DataFrame:
    """``dish_id, item_id, score, stage, sets_description, sets_photo`` for every scraped dish with something to add and a matching restaurant.

    ``scraped``: ``dish_id, park, restaurant, name, description, photo_url``,
    told apart and ordered by ``dish_id``.  Restaurants of the park match by edit
    similarity over ``RESTAURANT_ABOVE`` or, where none does, by one name holding
    the other.  An item of these over ``ITEM_ABOVE`` is the match; one below
    ``SURE`` gives way to a better one of the whole park over ``PARK_ABOVE``.
    Ties go to the least id.  Only missing texts are set, by the first dish that
    has one.  Only names travel through the joins; equal ones of a park are one.
    """
    rows = scraped.where((_have("description") | _have("photo_url")) & F.col("park").isNotNull()).select(
        "dish_id", "park", spaced_name(F.col("restaurant")).alias("restaurant_"), spaced_name(F.col("name")).alias("name_"),
        _have("description").alias("has_description"), _have("photo_url").alias("has_photo"))
    rows = stored(rows, "dishes")
    known = wide.where("park_name IS NOT NULL").select("item_id", "restaurant_id", F.col("park_name").alias("park"), spaced_name(F.col("restaurant_name")).alias("restaurant"),
                                                       spaced_name(F.col("name")).alias("known"), _have("description").alias("described"), _have("photo_url").alias("shown"))
    known = stored(known, "catalogue")
    asked = rows.select(F.col("park").alias("block"), F.col("restaurant_").alias("name")).distinct()
    there = known.select(F.col("park").alias("block"), F.col("restaurant").alias("name")).distinct()
    similar = stored(matching.edit_pairs(asked, there, RESTAURANT_ABOVE).select("block", "asked", "known"), "similar")
    left = asked.join(similar.select("block", F.col("asked").alias("name")), ["block", "name"], "left_anti")
    places = similar.unionByName(matching.contained_pairs(left, there)).toDF("park", "restaurant_", "restaurant")
    places = stored(places, "places")

    pairs = matching.edit_pairs(rows.select(F.col("park").alias("block"), F.col("name_").alias("name")), known.select(F.col("park").alias("block"), F.col("known").alias("name")), ITEM_ABOVE)
    # Files of few different values are small, what they hold is not: such tables are not sent whole to all.
    pairs = stored(pairs.toDF("park", "name_", "known", "score"), "name_pairs").hint("merge")
    least = lambda *keys: known.groupBy("park", "known", *keys).agg(F.min("item_id").alias("item_id"))
    best = lambda df, *keys: df.groupBy("park", "name_", *keys).agg(F.min(F.struct((-F.col("score")).alias("s"), "item_id")).alias("best"))
    wanted = rows.join(places.select("park", "restaurant_").distinct(), ["park", "restaurant_"], "left_semi")
    own = wanted.select("park", "restaurant_", "name_").distinct().join(pairs, ["park", "name_"]).join(places, ["park", "restaurant_"])
    own = best(own.join(least("restaurant"), ["park", "known", "restaurant"]), "restaurant_").select("park", "name_", "restaurant_", F.col("best").alias("own"))
    anywhere = best(pairs.where(F.col("score") > PARK_ABOVE).join(least(), ["park", "known"])).select("park", "name_", F.col("best").alias("anywhere"))
    found = wanted.join(own, ["park", "name_", "restaurant_"], "left").join(anywhere, ["park", "name_"], "left")
    score = F.coalesce(-F.col("own.s"), F.lit(0.0))
    retried = (score < SURE) & (-F.col("anywhere.s") > score)
    found = found.select("dish_id", "has_description", "has_photo", F.when(retried, F.col("anywhere.item_id")).otherwise(F.col("own.item_id")).alias("item_id"),
                         F.when(retried, -F.col("anywhere.s")).otherwise(-F.col("own.s")).alias("score"),
                         F.when(retried, "park").when(F.col("own").isNotNull(), "restaurant").alias("stage"))
    found = stored(found, "matches")
    first = found.groupBy("item_id").agg(F.min(F.when(F.col("has_description"), F.col("dish_id"))).alias("describes"), F.min(F.when(F.col("has_photo"), F.col("dish_id"))).alias("shows"))
    to_set = first.join(known.select("item_id", "described", "shown").hint("merge"), "item_id")
    out = found.join(to_set.hint("merge"), "item_id", "left")
    sets = lambda by, there: F.coalesce((F.col("dish_id") == F.col(by)) & ~F.col(there), F.lit(False))
    return out.select("dish_id", "item_id", "score", "stage", sets("describes", "described").alias("sets_description"), sets("shows", "shown").alias("sets_photo"))


# --- one to one, in order --------------------------------------------------------------

def assign_in_order(asking: DataFrame, wishes: DataFrame) -> DataFrame:
    """``asker, choice``: each asker in turn takes the best choice of its group that is still free.

    ``asking``: ``asker`` (the order) and ``wish``, its group; ``wishes``:
    ``wish, at, choice``, a group's choices numbered from 1 on, best first.

    Rounds go on until no two want the same: an asker wants the choice at its
    place; of those who want one, the first keeps it and the others move on by
    one place.  A choice is only ever lost to an earlier asker, so this ends
    where taking turns would.  The n-th asker of a group gets none of the first
    n - 1 places that its group still holds, so a group spreads over its choices
    in one round, and no pair of asker and choice is made but the wanted ones.
    """
    order = Window.partitionBy("wish").orderBy("asker")
    state = asking.join(wishes.select("wish").distinct(), "wish", "left_semi").select("asker", "wish", F.row_number().over(order).cast("long").alias("nth"), F.lit(1).cast("long").alias("at"))
    wishes = stored(wishes.select("wish", F.col("at").cast("long").alias("at"), "choice"), "wishes")
    while True:
        shift = F.max(F.col("at") - F.col("nth")).over(order)
        wanted = state.select("asker", "wish", "nth", (F.col("nth") + shift).alias("at")).join(wishes, ["wish", "at"])  # past the last choice: none is left
        wanted = stored(wanted, "wanted")
        first = wanted.groupBy("choice").agg(F.min("asker").alias("first"), F.count("*").alias("n"))
        lost = stored(wanted.join(first.where("n > 1"), "choice").where("asker != first").select("asker"), "lost")
        if lost.isEmpty():
            return wanted.select("asker", "choice")
        state = wanted.join(lost.withColumn("moves", F.lit(1)), "asker", "left").select("asker", "wish", "nth", (F.col("at") + F.coalesce("moves", F.lit(0))).alias("at"))


def _in_turn(turns: DataFrame) -> DataFrame:
    """``asker, choice, score`` from ``turns``, whose partitions hold whole parts in the order of ``part, kind, a, score, b``.

    Of a part there come its items (kind 0: set ``a``, item ``b``, a ``score`` if
    it is in other sets, too), then what its wishes want (1: wish ``a``, set
    ``b``, ``score``), then its askers (2: asker ``a``, wish ``b``).  The items of
    a set are taken in their order, so a place in each set says which are free; a
    row is read at a time.  A repeated row of an asker takes a turn of its own,
    and what one has is there as often as asker and item are.
    """
    def run(batches):
        from array import array
        from bisect import bisect_left, bisect_right
        from itertools import chain

        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.float64())
        part, asker, n, took = None, None, 0, []
        free, next_, wants, again, gone = {}, {}, {}, set(), set()

        def wanted(wish):
            """The best free item's score, itself and its set."""
            best, left = None, []
            for score, of in wants[wish]:
                items, at = free[of], next_.get(of, 0)
                while at < len(items) and items[at] in gone:
                    at += 1
                next_[of] = at
                if at < len(items):
                    left.append((score, of))
                    if best is None or (-score, items[at]) < (-best[0], best[1]):
                        best = score, items[at], of
                    elif score < best[0]:
                        return best
            wants[wish] = left
            return best

        for batch in chain(batches, [None]):
            out = ([], [], [])
            for own, kind, a, score, b in zip(*(c.to_pylist() for c in batch.columns)) if batch is not None else [(None, 2, None, None, None)]:
                if own != part or (kind == 2 and a != asker):
                    for item, value, copies in took:
                        for column, v in zip(out, (asker, item, value)):
                            column.extend([v] * n * copies)
                    asker, n, took = a, 0, []
                if own != part:
                    part, free, next_, wants, again, gone = own, {}, {}, {}, set(), set()
                if own is None:
                    continue
                if kind == 0:
                    free.setdefault(a, array("q")).append(b)
                    if score:
                        again.add(b)
                elif kind == 1:
                    wants.setdefault(a, []).append((score, b))
                else:
                    n += 1
                    if best := wanted(b):
                        value, item, of = best
                        next_[of] = bisect_right(free[of], item)
                        took.append((item, value, next_[of] - bisect_left(free[of], item)))
                        if item in again:
                            gone.add(item)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["asker", "choice", "score"])

    return turns.mapInArrow(run, "asker long, choice long, score double")


def match_photos(photos: DataFrame, items: DataFrame) -> DataFrame:
    """``photo_id, item_id, score``: at most one item per photo and one photo per item, photos choosing in order of ``photo_id``.

    ``photos``: ``photo_id, park, keywords``; ``items``: ``item_id, park, name``.
    A keyword of ``PHOTO_WORD_LENGTH`` letters that is a word of the name is a
    hit, as often as it is given; from ``PHOTO_WORDS`` hits on, the score is
    their number over the square root of the name's number of distinct words.
    The best score from ``PHOTO_SCORE`` on wins, ties to the least id.

    Items of a park with the same words are one set, photos with the same
    keywords one wish.  Photos whose wishes share no set, however indirectly,
    never meet: each such part takes its turns by itself, as one sorted stream.
    """
    name = spaced_name(F.col("name"))
    own = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "park", F.array_sort(matching.words(name)).alias("words"))
    own = stored(own, "items")
    usable = F.array_sort(F.filter("keywords", lambda w: F.length(w) >= PHOTO_WORD_LENGTH))
    asking = stored(photos.where("photo_id IS NOT NULL").select(F.col("photo_id").cast("long").alias("asker"), "park", usable.alias("keywords")), "photos")
    number = F.monotonically_increasing_id()
    groups = stored(asking.select("park", "keywords").distinct().withColumn("wish", number), "wishes")
    sets = stored(own.select("park", "words").distinct().withColumn("set", number), "sets")
    # Names and keyword lists are met once each, by word and park.
    word = lambda df, key, c: matching.spread(df).select(key, "park", F.explode(c).alias("word"))
    met = word(groups, "wish", "keywords").hint("merge").join(word(sets, "set", "words"), ["park", "word"])
    hits = met.groupBy("wish", "set").agg(F.count("*").alias("hits")).where(F.col("hits") >= PHOTO_WORDS)
    scored = hits.hint("merge").join(sets.select("set", F.size("words").cast("double").alias("n")), "set").select("wish", "set", (F.col("hits") / F.sqrt("n")).alias("score"))
    scored = stored(scored.where(F.col("score") >= PHOTO_SCORE), "scored")

    # Wishes have odd numbers and sets even ones in the graph of what may meet; an item under two names joins its sets.
    placed = stored(own.join(sets.hint("merge"), ["park", "words"]).select("item_id", "set"), "placed")
    named = placed.groupBy("item_id").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most").select("item_id", "least")
    named = stored(named, "named_twice")
    same = placed.join(named.hint("merge"), "item_id").where("set != least").select((F.col("least") * 2).alias("a"), (F.col("set") * 2).alias("b"))
    part = roots(scored.select((F.col("wish") * 2 + 1).alias("a"), (F.col("set") * 2).alias("b")).unionByName(same.distinct()))
    part = stored(part.toDF("node", "part"), "parts")
    of = lambda c, odd: part.where(F.col("node") % 2 == odd).select(F.shiftright("node", 1).alias(c), "part")
    row = lambda df, kind, a, score, b: df.select("part", F.lit(kind).alias("kind"), F.col(a).alias("a"), score.cast("double").alias("score"), F.col(b).alias("b"))
    none = F.lit(None)
    of_item = placed.join(of("set", 0).hint("merge"), "set").join(named.withColumn("more", F.lit(1)).hint("merge"), "item_id", "left")
    of_wish = groups.hint("merge").join(of("wish", 1), "wish").select("park", "keywords", "wish", "part")
    turns = row(of_item, 0, "set", F.col("more"), "item_id").unionByName(
        row(scored.hint("merge").join(of("wish", 1), "wish"), 1, "wish", F.col("score"), "set")).unionByName(
        row(asking.join(of_wish.hint("merge"), ["park", "keywords"]), 2, "asker", none, "wish"))
    turns = turns.repartition("part").sortWithinPartitions("part", "kind", F.when(F.col("kind") != 1, F.col("a")), F.when(F.col("kind") == 1, -F.col("score")), "b")
    return _in_turn(turns).select(F.col("asker").alias("photo_id"), F.col("choice").alias("item_id"), "score")


# --- nearest neighbours by keywords -----------------------------------------------------

def food_keywords(name: Column) -> Column:
    """Kinds of food whose terms the normalised name holds, and its longer words but for stop words, each once and sorted."""
    key = match_name(name)
    held = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(key, t))
    kinds = [F.when(held(terms), F.lit(kind)) for kind, terms in FOOD_KEYWORDS.items()]
    own = F.filter(matching.words(key), lambda w: (F.length(w) > KEYWORD_LENGTH) & ~w.isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.array(*kinds), lambda k: k.isNotNull()), own)))


def _similar_sets(asked: DataFrame, known: DataFrame, block: list[str]) -> DataFrame:
    """``block, asked, known, similarity`` of keyword sets from half in common on: pairs share a word of both prefixes."""
    def prefix(c: str) -> Column:
        longest = F.transform(F.array_sort(F.transform(F.col(c), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda s: s["w"])
        return F.slice(longest, 1, F.size(longest) - F.ceil(F.size(longest) / F.lit(2)).cast("int") + 1)

    a = asked.select(*block, "asked", F.explode(prefix("asked")).alias("word"))
    b = known.select(*block, "known", F.explode(prefix("known")).alias("word"))
    met = a.join(b, [*block, "word"]).select(*block, "asked", "known").distinct()
    share = F.size(F.array_intersect("asked", "known")).cast("double") / F.size(F.array_union("asked", "known"))
    return met.withColumn("similarity", F.floor(share * 100).cast("long")).where(F.col("similarity") >= LEAST_SIMILARITY)


def _nearest(asked: DataFrame, existing: DataFrame, block: list[str]) -> DataFrame:
    """``block, asked, near``: of each keyword set the ``NEIGHBOURS`` most similar items, ties to the least id."""
    nth = F.row_number().over(Window.partitionBy(*block, "known").orderBy("item_id"))
    few = existing.select(*block, F.col("keywords").alias("known"), "item_id").withColumn("nth", nth).where(F.col("nth") <= NEIGHBOURS)
    pairs = _similar_sets(asked, few.select(*block, "known").distinct(), block).join(few, [*block, "known"])
    place = F.row_number().over(Window.partitionBy(*block, "asked").orderBy(F.desc("similarity"), "item_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= NEIGHBOURS).select(*block, "asked", "place", "similarity", "item_id")


def estimate_by_neighbours(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Estimates for every row of ``new(item_id, name, category)`` from ``existing`` items, which also have nutrients.

    Only existing items with calories count.  The pool is the own category where
    it has ``LEAST_POOL`` items, else all; the estimate is the mean of the
    ``NEIGHBOURS`` most similar ones weighted by similarity (unknown values are 0
    there), ``sugar``, ``fiber`` and ``sodium`` only where all of them know it.
    ``needs_manual``: no estimate, or a confidence under ``LEAST_CONFIDENCE``.
    Equal keyword sets are one, so a dish that many rows name is compared once.
    """
    existing = stored(existing.where("calories != 0").select("item_id", "category", food_keywords(F.col("name")).alias("keywords"), *ALWAYS, *ALL_OR_NONE), "existing")
    sizes = existing.groupBy("category").agg((F.count("*") >= LEAST_POOL).alias("own_pool"))
    rows = new.select("item_id", "category", food_keywords(F.col("name")).alias("asked")).join(sizes, "category", "left")
    rows = stored(rows.withColumn("own_pool", F.coalesce("own_pool", F.lit(False))), "new_items")
    own = _nearest(rows.where("own_pool").select("category", "asked").distinct(), existing, ["category"]).select("category", F.lit(True).alias("own_pool"), "asked", "place", "similarity", "item_id")
    one = F.lit(0).alias("all_")
    every = _nearest(rows.where("NOT own_pool").select("asked", one).distinct(), existing.select("*", one), ["all_"])
    open_ = rows.where("NOT own_pool").select("category", "own_pool", "asked").distinct()
    every = open_.join(every.drop("all_"), "asked").select("category", "own_pool", "asked", "place", "similarity", "item_id")
    near = own.unionByName(every).join(existing.drop("category", "keywords"), "item_id")
    weight = F.sum("similarity")
    mean = lambda c: F.floor(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("similarity")).cast("double") / weight + 0.5).cast("long")
    estimate = near.groupBy("category", "own_pool", "asked").agg(
        *[mean(c).alias(c) for c in ALWAYS], *[F.when(F.count(c) == F.count("*"), mean(c)).alias(c) for c in ALL_OR_NONE],
        F.floor(F.max("similarity") * CONFIDENCE_SHARE + 0.5).cast("long").alias("confidence"), F.count("*").alias("neighbours"))
    same = rows["category"].eqNullSafe(estimate["category"]) & (rows["own_pool"] == estimate["own_pool"]) & (rows["asked"] == estimate["asked"])
    out = rows.join(estimate, same, "left").select(rows["item_id"], *ALWAYS, *ALL_OR_NONE, "confidence", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
    return out.withColumn("needs_manual", F.coalesce(F.col("confidence") < LEAST_CONFIDENCE, F.lit(True)))
