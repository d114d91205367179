"""Fuzzy search over item name, restaurant and description.

A field's distance from a query is 0 where it contains the query, else the mean
over the query's words of the edit distance to the field's nearest word, as a
share of the longer of the two.  Items with a field within the threshold are
hits; their relevance weighs all fields, those beyond the threshold as 1.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trencher.operators.browse import FilterSpec, apply_filters, search_filters, sort_keys

# The weight of each field, the largest distance of a hit and the shortest query.
WEIGHTS = {"name": 2.0, "restaurant_name": 1.5, "description": 1.0}
THRESHOLD, MIN_LENGTH = 0.4, 2
EDGES = "[^a-z0-9]+"


def _nearest(tokens: Column, word: str) -> Column:
    share = lambda t: F.levenshtein(t, F.lit(word)) / F.greatest(F.length(t), F.lit(len(word)))
    return F.coalesce(F.array_min(F.transform(tokens, share)), F.lit(1.0))


def _distance(text: Column, tokens: Column, query: str) -> Column:
    words = [w for w in re.split(EDGES, query) if w]
    nearest = [_nearest(tokens, w) for w in words]
    total = sum(nearest[1:], nearest[0]) / len(words) if words else F.lit(1.0)
    return F.when(F.contains(text, F.lit(query)), 0.0).otherwise(total)


def fuzzy_hits(wide: DataFrame, queries: Sequence[str], key: str = "item_id") -> DataFrame:
    """``query, key, relevance`` (thousandths, 0 is best) of all hits of each query, in one pass over the items.

    Queries are trimmed and lower-cased; shorter ones than two characters find nothing.
    """
    asked = [q for q in dict.fromkeys(q.strip().lower() for q in queries) if len(q) >= MIN_LENGTH]
    texts = wide.select(key, *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in WEIGHTS])
    df = texts.select(key, *WEIGHTS, *[F.array_distinct(F.filter(F.split(f, EDGES), lambda t: t != "")).alias(f"{f}_words") for f in WEIGHTS])
    if not asked:
        return df.limit(0).select(F.lit("").alias("query"), key, F.lit(0).cast("long").alias("relevance"))
    found = F.array(*[F.struct(F.lit(q).alias("query"), *[_distance(F.col(f), F.col(f"{f}_words"), q).alias(f) for f in WEIGHTS]) for q in asked])
    hits = df.select(key, F.inline(found)).where(F.least(*WEIGHTS) <= THRESHOLD)
    terms = [w * F.when(F.col(f) <= THRESHOLD, F.col(f)).otherwise(1.0) for f, w in WEIGHTS.items()]
    relevance = sum(terms[1:], terms[0]) / sum(WEIGHTS.values())
    return hits.select("query", key, F.floor(relevance * 1000 + F.lit(0.5)).cast("long").alias("relevance"))


def search_pages(wide: DataFrame, allergens: DataFrame, queries: Sequence[str], spec: FilterSpec, visible: int) -> DataFrame:
    """``query, position, item_id, relevance, total_matches, has_more``: the first ``visible`` hits of each query.

    The options of ``spec`` that apply on top of a search thin the hits out, and
    its sort, not the relevance, orders them; a query without hits left has no rows.
    """
    shown = apply_filters(wide, allergens, search_filters(spec))
    found = shown.join(fuzzy_hits(wide, queries), "item_id")
    totals = found.groupBy("query").agg(F.count("*").alias("total_matches"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*sort_keys(spec.sort)))
    first = found.withColumn("position", place).where(F.col("position") <= visible)
    return first.join(totals, "query").select("query", "position", "item_id", "relevance", "total_matches", (F.col("total_matches") > visible).alias("has_more"))
