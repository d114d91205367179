"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in order;
pivots are spread over a sample, so a crowd of close vectors gets few of them.
The table is dealt into tiles of bounded size; in each, every pivot has an
inverted file of the vectors that have it in their prefix, with its place.  A
query's prefix fetches the files of its pivots, which add up the footrule
distance: with ``m`` places, a pivot that both have at places ``x`` and ``y``
takes ``2 (m - max(x, y))`` from the distance of two prefixes without a common
pivot.  The nearest ``SHARE`` of each tile by footrule, ties included, are
reranked by their true distance there, where their vectors are; the best of all
tiles are the result.

No pair of rows is shuffled: queries come in tiles, too, and each tile of
vectors meets each tile of queries once.  Equal vectors are one class, which is
indexed once; the result lists its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trencher.llm.shared import stored, type_of

#: The index is fitted on so many vectors, those of least hash; every vector is indexed.
SAMPLE = 2048
PIVOTS = 256
PREFIX = 64
SHARE = 0.25
LEAST = 64
TILE_ROWS = 4096
TILE_BYTES = 1 << 24
NEAREST = 10
ASKED_AT_ONCE = 256


def _usable(vector: str):
    """The vector as doubles; null where it is null, zero or holds a null or non-finite component."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0), v)


def _spread(sample, n: int):
    """``n`` vectors of the sample, each as far from those before it as any, so that close vectors do not take several pivots."""
    import numpy as np

    chosen, near = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _prefixes(vectors, pivots, m: int):
    """The ``m`` nearest pivots of each vector, nearest first, ties to the smaller number."""
    import numpy as np

    near = (pivots ** 2).sum(1) - 2 * vectors @ pivots.T
    return np.argsort(near, axis=1, kind="stable")[:, :m]


def _padded(lists, n: int):
    """Vectors as rows of one matrix; shorter ones end in zeros."""
    import numpy as np

    if all(len(v) == n for v in lists):
        return np.array(lists, np.float64).reshape(len(lists), n)
    out = np.zeros((len(lists), n))
    for row, v in zip(out, lists):
        row[:len(v)] = v
    return out


def _tiles(classes: DataFrame, tiles: int, rows: int, dimension: int) -> DataFrame:
    """``tile, ids, vectors``: the classes of a tile number in parts of at most ``rows`` vectors, as bytes."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        tile, ids, vectors = None, [], []

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([_padded(vectors, dimension).tobytes()])],
                                              ["tile", "ids", "vectors"])

        for batch in batches:
            for of, i, v in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (of != tile or len(ids) == rows):
                    yield flushed()
                    ids, vectors = [], []
                tile = of
                ids.append(i)
                vectors.append(v)
        if ids:
            yield flushed()

    dealt = classes.select(F.pmod(F.xxhash64("class"), F.lit(tiles)).cast("int").alias("tile"), "class", "vector")
    return dealt.repartition(tiles, "tile").sortWithinPartitions("tile", "class").mapInArrow(run, "tile int, ids binary, vectors binary")


def _inverted(prefixes, pivots: int):
    """The inverted file of each pivot, as a row: ``m - place`` of each vector that has it in its prefix, 0 for the others."""
    import numpy as np

    n, m = prefixes.shape
    files = np.zeros((pivots, n), np.uint16 if m <= 256 else np.uint32)  # a sum over a prefix is m (m + 1) / 2 at most
    files[prefixes, np.arange(n)[:, None]] = m - np.arange(m)
    return files


def _rough(queries, vectors):
    """Squared distances by one product of matrices, and for each query how far they may be from those of differences."""
    import numpy as np

    own, other = (queries ** 2).sum(1), (vectors ** 2).sum(1)
    longest = np.sqrt(own) + np.sqrt(other.max())
    slack = 4 * (vectors.shape[1] + 8) * (np.finfo(float).eps * longest ** 2 + np.finfo(float).tiny)
    return own[:, None] + other - 2 * (queries @ vectors.T), slack


def _found(query, prefix, files, vectors, rough, slack, share: float, least: int, k: int):
    """The ``k`` nearest vectors of a tile among those nearest by footrule: numbers and squared distances.

    ``rough`` distances, right to ``slack``, leave out what cannot be among the ``k``, so few differences are made.
    """
    import numpy as np

    n, m = len(vectors), len(prefix)
    # Half of what common pivots take from the footrule distance.
    common = np.minimum(files[prefix], (m - np.arange(m)).astype(files.dtype)[:, None]).sum(0, dtype=files.dtype)
    wanted = min(n, max(least, int(np.ceil(share * n))))
    near = np.nonzero(common >= np.partition(common, n - wanted)[n - wanted])[0]
    if len(near) > k:
        rough = rough[near]
        near = near[~(rough > np.partition(rough, k - 1)[k - 1] + 2 * slack)]  # what is not a number stays
    distance = ((vectors[near] - query) ** 2).sum(1)
    if len(near) > k:
        best = np.nonzero(distance <= np.partition(distance, k - 1)[k - 1])[0]
        near, distance = near[best], distance[best]
    return near, distance


def nearest_classes(classes: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query, class, score``: for each class of ``queries`` at least the ``k`` nearest classes found, itself among them.

    Both have ``class`` (a long) and ``vector``; ties at the last place are kept.
    """
    import numpy as np

    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    n, dimension = size["n"], size["d"] or 1
    sample = [r["vector"] for r in classes.orderBy(F.xxhash64("vector"), "class").select("vector").limit(SAMPLE).collect()]
    chosen = _spread(_padded(sample, dimension), pivots) if sample else np.zeros((1, dimension))
    m = min(prefix, len(chosen))
    rows = max(LEAST, min(tile_rows, TILE_BYTES // (8 * dimension)))
    numbers = max(1, -(-n // rows))

    def searched(batches):
        import numpy as np
        import pyarrow as pa

        last, files, vectors, ids = None, None, None, None
        for batch in batches:
            for of, own, asked, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                if of != last:
                    last, ids, vectors = of, np.frombuffer(of, np.int64), np.frombuffer(own).reshape(-1, dimension)
                    files = _inverted(_prefixes(vectors, chosen, m), len(chosen))
                asked, wanted = np.frombuffer(asked, np.int64), np.frombuffer(wanted).reshape(-1, dimension)
                out = ([], [], [])
                for at in range(0, len(asked), ASKED_AT_ONCE):
                    block = wanted[at:at + ASKED_AT_ONCE]
                    for q, v, p, *rough in zip(asked[at:], block, _prefixes(block, chosen, m), *_rough(block, vectors)):
                        near, distance = _found(v, p, files, vectors, *rough, share, LEAST, k)
                        for column, values in zip(out, (np.full(len(near), q), ids[near], np.sqrt(distance))):
                            column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query", "class", "score"])

    tiles = stored(_tiles(classes, numbers, rows, dimension), "tiles")
    asked = _tiles(queries, max(1, -(-queries.count() // rows)), rows, dimension)
    asked = stored(asked.select(F.col("ids").alias("asked"), F.col("vectors").alias("wanted")), "query_tiles")
    # The stated queries against all rows, tile by tile; no copy of the queries for each tile is broadcast or shuffled.
    met = tiles.crossJoin(asked)
    found = met.select("ids", "vectors", "asked", "wanted").mapInArrow(searched, "query long, class long, score double")
    place = F.rank().over(Window.partitionBy("query").orderBy("score"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = NEAREST, **parameters) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row whose ``key`` is divisible by ``every``.

    ``score`` is the Euclidean distance; ties go to the smaller key.  All rows
    but the query's own are candidates, repeated keys included; fewer than ``k``
    give all.  Rows of a null key, or whose vector is null, zero or holds a null
    or non-finite component, take no part; shorter vectors count as if zeros
    followed.  Other columns are not read; an empty table gives an empty one.
    """
    given = rows.select(F.col(f"`{key}`").alias("id"), _usable(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    # Equal vectors meet by 128 bits of hashes: as keys, arrays would be brought to a normal form in every comparison.
    given = given.select("*", F.monotonically_increasing_id().alias("row"), F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g"))
    given = stored(given, "vectors")
    firsts = given.groupBy("h", "g").agg(F.min("row").alias("class"))
    of = stored(given.select("id", "row", "h", "g").join(firsts, ["h", "g"]).select("id", "row", "class"), "of_class")
    classes = stored(given.select(F.col("row").alias("class"), "vector").join(of.where("row = class").select("class"), "class", "left_semi"), "classes")
    asked = of.where(F.col("id") % every == 0)
    queries = classes.join(asked.select("class").distinct(), "class", "left_semi")
    near = stored(nearest_classes(classes, queries, k + 1, **parameters), "near_classes")
    nth = F.row_number().over(Window.partitionBy("class").orderBy("id", "row"))
    members = of.join(near.select("class").distinct(), "class", "left_semi").withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    ranked = F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "row"))
    found = near.join(members, "class").withColumn("nth", ranked).where(F.col("nth") <= k + 1).select("query", "nth", F.col("id").alias("found"), F.col("row").alias("found_row"), "score")
    lists = stored(found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("nth", "found", "found_row", "score"))).alias("near")), "lists")  # k + 1 at most
    out = asked.join(lists, asked["class"] == lists["query"]).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["found_row"] != F.col("row")), 1, k).alias("near"))
    out = out.select("query_id", F.posexplode("near").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.found").alias(key), F.col("x.score").alias("score"))
