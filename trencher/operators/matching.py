"""Matching names of one table to those of another, inside blocks, without comparing all pairs.

Each matcher first makes candidates by equi-joins on keys that every pair above
its threshold shares, so no match is lost; then it scores the candidates exactly
and takes the best.  Equal names of a block are one name, so a name that a third
of all rows carry is compared once.  Blocks and keys are join keys only: no task
gathers a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trencher.functions.text import words
from trencher.operators.storage import stored

#: Longer names meet by the first ``GRAM`` characters of the shorter one instead of by all its substrings.
LONG, GRAM = 256, 64
#: Names that are no longer meet by segments for every pair of lengths, others by chunks of one length.
SHORT = 32


# --- scores -------------------------------------------------------------------------

def name_score(a: Column, b: Column) -> Column:
    """Score of two normalised names from 0 to 100: equal 100; one within the other up to 90 by length; else words in common up to 80."""
    n, m = F.length(a), F.length(b)
    inside = F.floor(F.least(n, m).cast("double") / F.greatest(n, m) * 90)
    common = F.size(F.array_intersect(words(a), words(b))).cast("double") / F.size(F.array_union(words(a), words(b)))
    return F.when(a == b, 100).when(F.contains(a, b) | F.contains(b, a), inside).otherwise(F.floor(common * 80)).cast("int")


def edit_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance as a share of the longer name; 1 for two empty ones."""
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)).cast("double"))


# --- keys that every match shares ---------------------------------------------------

def _substrings(name: Column, share: float) -> Column:
    """Hashes of all substrings of at least ``share`` of the name; of long names, those under ``GRAM`` and the grams that longer ones begin with."""
    n = F.length(name)
    least = F.greatest(F.ceil(n * F.lit(share) - F.lit(1e-6)).cast("int"), F.lit(1))
    each = lambda of: F.transform(F.sequence(F.lit(1), n - of + 1), lambda at: F.xxhash64(F.substr(name, at, of)))
    every = lambda most: F.flatten(F.transform(F.sequence(least, most), each))
    grams = F.transform(F.sequence(F.lit(1), n - F.greatest(least, F.lit(GRAM)) + 1), lambda at: F.xxhash64(F.lit("gram"), F.substr(name, at, F.lit(GRAM))))
    under = F.when(least < GRAM, every(F.lit(GRAM - 1))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.array(F.xxhash64(name))).when(n <= LONG, every(n)).otherwise(F.concat(grams, under))


def _whole(name: Column) -> Column:
    """The keys under which a name is found as a substring."""
    grams = F.array(F.xxhash64(name), F.xxhash64(F.lit("gram"), F.substr(name, F.lit(1), F.lit(GRAM))))
    return F.when(F.length(name) >= GRAM, grams).otherwise(F.array(F.xxhash64(name)))


def _ranked_words(name: Column) -> Column:
    """Distinct words, long ones first: an order that is the same for all names and has common words late."""
    by_length = F.array_sort(F.transform(words(name), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(by_length, lambda s: s["w"])


def _word_keys(ranked: Column, share: float, left: bool) -> Column:
    """Keys that any two sets of words with Jaccard similarity ``share`` or more have in common.

    Sets of one size that can only match when they are equal meet by the whole
    set; others by a word of both prefixes and the size of the right one.
    """
    n = F.size(ranked)
    equal_up_to = next(k for k in range(1, 1000) if math.ceil(share / (1 + share) * 2 * (k + 1) - 1e-9) <= k)
    least, most = F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int"), F.floor(n / F.lit(share) + F.lit(1e-9)).cast("int")
    whole = F.xxhash64(F.lit("set"), F.array_join(F.array_sort(ranked), " "))
    prefix = F.slice(ranked, 1, n - least + 1)
    if not left:
        keys = F.transform(prefix, lambda w: F.xxhash64(F.lit("word"), n, w))
    else:
        sizes = F.filter(F.sequence(F.greatest(least, F.lit(1)), most), lambda m: (m != n) | (n > equal_up_to))
        keys = F.flatten(F.transform(sizes, lambda m: F.transform(prefix, lambda w: F.xxhash64(F.lit("word"), m, w))))
    return F.concat(F.array(whole), keys)


def _segment(m: Column, of: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of the ``i``-th (from 0) of ``of`` near-equal segments of ``m`` characters."""
    base, more = F.floor(m / of).cast("int"), (m % of).cast("int")
    return (i * base + F.greatest(i - (of - more), F.lit(0)) + 1).cast("int"), (base + F.when(i >= of - more, 1).otherwise(0)).cast("int")


def _most_edits(longest: Column, above: float) -> Column:
    """An edit distance that no pair of similarity over ``above`` exceeds."""
    return F.floor(longest * F.lit(1 - above) + F.lit(1e-9)).cast("int")


def _segment_keys(name: Column, above: float, left: bool) -> Column:
    """Keys that two names of at most ``SHORT`` characters and edit similarity over ``above`` share.

    A name cut into one segment more than there are edits keeps a segment whole,
    near its place in the other name.  ``left`` names are looked up in the
    segments of the other ones, for all lengths that can match.
    """
    n, none = F.length(name), F.array().cast("array<bigint>")
    most = F.least(F.floor(n / F.lit(above) + F.lit(1e-9)).cast("int"), F.lit(SHORT))
    if not left:
        edits = F.array_distinct(F.transform(F.sequence(n, most), lambda m: _most_edits(m, above)))

        def cut(k: Column) -> Column:
            def key(i: Column) -> Column:
                start, long = _segment(n, k + 1, i)
                return F.xxhash64(n, k, i, F.substr(name, start, long))

            return F.transform(F.sequence(F.lit(0), k), key)

        return F.when(n <= SHORT, F.flatten(F.transform(edits, cut))).otherwise(none)

    def met(m: Column) -> Column:
        k = _most_edits(F.greatest(n, m), above)

        def keys(i: Column) -> Column:
            start, long = _segment(m, k + 1, i)
            first = F.greatest(start - i, start + (n - m) - (k - i), F.lit(1))
            last = F.least(start + i, start + (n - m) + (k - i), n - long + 1)
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.xxhash64(m, k, i, F.substr(name, at, long)))

        return F.flatten(F.transform(F.sequence(F.lit(0), k), keys))

    lengths = F.sequence(F.ceil(n * F.lit(above) - F.lit(1e-9)).cast("int"), most)
    return F.when(n <= SHORT, F.flatten(F.transform(lengths, met))).otherwise(none)


def _chunk(above: float) -> int:
    """The longest chunks of which a name over ``SHORT`` characters has more than edits that ``above`` allows."""
    enough = lambda c: all(m // c > math.floor(m * (1 - above) + 1e-9) for m in range(SHORT + 1, SHORT + 1000))
    return next(c for c in range(SHORT, 0, -1) if enough(c))


def _chunk_keys(name: Column, above: float, longer: bool) -> Column:
    """Keys that a name of over ``SHORT`` characters shares with any no longer one of edit similarity over ``above``.

    Of one chunk more than there are edits, one is whole and has at most as many
    edits before it as chunks: it stands so far from its place at most.
    """
    n, c, none = F.length(name), _chunk(above), F.array().cast("array<bigint>")
    if longer:
        chunks = F.transform(F.sequence(F.lit(0), _most_edits(n, above)), lambda i: F.xxhash64(i, F.substr(name, i * c + 1, F.lit(c))))
        return F.when(n > SHORT, chunks).otherwise(none)

    def near(i: Column) -> Column:
        first, last = F.greatest(i * c + 1 - i, F.lit(1)), F.least(i * c + 1 + i, n - c + 1)
        places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.xxhash64(i, F.substr(name, at, F.lit(c))))

    edits = _most_edits(n / F.lit(above), above)
    return F.when(n >= math.floor(SHORT * above), F.flatten(F.transform(F.sequence(F.lit(0), edits), near))).otherwise(none)


def _half_keys(name: Column, letters: int) -> tuple[Column, Column]:
    """Words of ``letters`` at least, ranked, and those of them of which two names with half the longer one's words in common share one."""
    ranked = F.filter(_ranked_words(name), lambda w: F.length(w) >= letters)
    return ranked, F.transform(F.slice(ranked, 1, F.size(ranked) - F.ceil(F.size(ranked) / 2).cast("int") + 1), lambda w: F.xxhash64(w))


# --- joins --------------------------------------------------------------------------

def _names(df: DataFrame, block: str, name: str) -> DataFrame:
    return df.select(F.col(block).alias("block"), F.col(name).alias("name")).where("block IS NOT NULL AND name IS NOT NULL")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: few small rows of which much is made would stand in one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _met(asked: DataFrame, known: DataFrame, left: Column, right: Column) -> DataFrame:
    """``block, asked, known``: names that share a block and a key.

    A name has hundreds of keys, which the planner does not count: their joins
    are shuffled, whatever it thinks of their size, and only numbers travel.
    """
    numbered = lambda df, name: stored(df.select("block", "name").withColumn("id", F.monotonically_increasing_id()), name)
    asked, known = numbered(asked, "asked"), numbered(known, "known")
    keyed = lambda df, keys, id_: spread(df).select(F.col("id").alias(id_), "block", F.explode(F.array_distinct(keys)).alias("key")).select(id_, F.xxhash64("block", "key").alias("key"))
    pairs = keyed(asked, left, "a").hint("merge").join(keyed(known, right, "b"), "key").select("a", "b").distinct()
    pairs = pairs.hint("merge").join(asked.select(F.col("id").alias("a"), "block", F.col("name").alias("asked")), "a")
    found = pairs.hint("merge").join(known.select(F.col("id").alias("b"), F.col("block").alias("other"), F.col("name").alias("known")), "b")
    return found.where("block = other").select("block", "asked", "known")


def _tagged(keys: list[tuple[Column, Column]], which: int) -> Column:
    """The keys of all ways to meet in one array, told apart by the way."""
    of = lambda i: (lambda h: F.xxhash64(F.lit(i), h))
    return F.concat(*[F.transform(k[which], of(i)) for i, k in enumerate(keys)])


def _named(rows: DataFrame, block: str, name: str) -> DataFrame:
    """``block, name``: each name of a block once."""
    return _names(rows, block, name).distinct()


def fuzzy_pairs(left: DataFrame, right: DataFrame, floor: int, block: str = "block", name: str = "name") -> DataFrame:
    """``block, asked, known, score`` of all names of a block whose ``name_score`` is ``floor`` (81 at most) or more.

    Names are normalised already; null names and blocks match nothing.
    """
    asked, known = _named(left, block, name), _named(right, block, name)
    inside, common, n = floor / 90, floor / 80, F.col("name")
    ranked = _ranked_words(n)
    keys = [(_substrings(n, inside), _whole(n)), (_whole(n), _substrings(n, inside))]
    if common <= 1:
        keys.append((_word_keys(ranked, common, True), _word_keys(ranked, common, False)))
    met = _met(asked, known, _tagged(keys, 0), _tagged(keys, 1))
    return met.withColumn("score", name_score(F.col("asked"), F.col("known"))).where(F.col("score") >= floor)


def edit_pairs(left: DataFrame, right: DataFrame, above: float, block: str = "block", name: str = "name") -> DataFrame:
    """``block, asked, known, score`` of all names of a block whose ``edit_similarity`` is more than ``above``."""
    asked, known = _named(left, block, name), _named(right, block, name)
    n = F.col("name")
    keys = [(_segment_keys(n, above, True), _segment_keys(n, above, False)), (_chunk_keys(n, above, True), _chunk_keys(n, above, False)),
            (_chunk_keys(n, above, False), _chunk_keys(n, above, True))]
    met = _met(asked, known, _tagged(keys, 0), _tagged(keys, 1))
    return met.withColumn("score", edit_similarity(F.col("asked"), F.col("known"))).where(F.col("score") > above)


def contained_pairs(left: DataFrame, right: DataFrame, block: str = "block", name: str = "name") -> DataFrame:
    """``block, asked, known`` where one name holds the other, at any length."""
    asked, known = _named(left, block, name), _named(right, block, name)
    n = F.col("name")
    every = F.concat(F.array(F.xxhash64(F.lit(""))), _substrings(n, 0.0))
    longer, shorter = _met(asked, known, every, _whole(n)), _met(asked, known, _whole(n), every)
    return longer.unionByName(shorter).distinct().where(F.contains("asked", F.col("known")) | F.contains("known", F.col("asked")))


def half_pairs(left: DataFrame, right: DataFrame, letters: int, block: str = "block", name: str = "name") -> DataFrame:
    """``block, asked, known, share`` of names with at least half of the longer one's words in common.

    Words of fewer than ``letters`` letters do not count; names without others match nothing.
    """
    asked, known = _named(left, block, name), _named(right, block, name)
    own = lambda c: _half_keys(F.col(c), letters)
    x, y = own("asked")[0], own("known")[0]
    share = F.size(F.array_intersect(x, y)).cast("double") / F.greatest(F.size(x), F.size(y))
    return _met(asked, known, own("name")[1], own("name")[1]).withColumn("share", share).where("share >= 0.5")


def best_of(pairs: DataFrame, ids: DataFrame, asked: list[str], score: str = "score", key: str = "id") -> DataFrame:
    """For each ``asked``, the ``key`` of the best score, ties to the least; ``ids`` has ``block, name, key``."""
    least = ids.where(f"{key} IS NOT NULL").groupBy(F.col("block"), F.col("name").alias("known")).agg(F.min(key).alias(key))
    found = pairs.hint("merge").join(least, ["block", "known"])  # stored pairs are small files of many rows
    best = found.groupBy(*asked).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias(key))).alias("best"))
    return best.select(*asked, F.col(f"best.{key}").alias(key), (-F.col("best.s")).alias(score))


def fuzzy_best(left: DataFrame, right: DataFrame, floor: int) -> DataFrame:
    """``block, asked, id, score``: the best fuzzy match of each name; both have ``block, name``, ``right`` also ``id``."""
    return best_of(fuzzy_pairs(left, right, floor), right, ["block", "asked"])


def within(left: DataFrame, right: DataFrame) -> DataFrame:
    """``asked, id``: rows of ``right(name, id)`` whose lower-cased name holds the lower-cased one asked for."""
    one = F.lit(0).alias("block")
    asked = left.select(F.lower("name").alias("asked"), one).distinct()
    known = right.select("id", F.lower("name").alias("known"), one)
    parts = spread(known).select("id", F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(F.lit(""))), _substrings(F.col("known"), 0.0)))).alias("key"), "known")
    return asked.withColumn("key", F.explode(_whole(F.col("asked")))).join(parts.hint("merge"), "key").where(F.contains("known", F.col("asked"))).select("asked", "id")
