"""SimHash near-duplicates by multi-index hashing.

Equal fingerprints are one class.  Two fingerprints that differ in at most three
bits differ in at most one bit of their upper or of their lower half, so a table
of both halves of each fingerprint is probed with every half itself and with the
half's neighbours at one bit.  Of two halves that differ in one bit, one has the
bit set: clearing set bits finds every pair, and setting bits is not needed.
Matches are verified on all 64 bits.

Halves that more than ``fine_above`` different fingerprints share are looked up
again by the other half's two quarters, one of which differs in at most one bit;
there the other quarter bounds how many can meet, and no link is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.components import roots
from trencher.llm.shared import stored, text_or_empty, type_of

WIDTH = 3
DISTANCE = 3
SEED = 42
FINE_ABOVE = 256
BLOCK = 100_000
LOW = 0xFFFFFFFF


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The fingerprint as a signed long; 0 for a text without words."""
    from itertools import accumulate, islice

    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)
    ends = (e - 1 for e in islice(starts, min(width, len(words)), None))
    hashes = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = np.fromiter(hashes, dtype="<u8", count=min(BLOCK, n - at))
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key`` (whatever its name was) and ``fingerprint`` (long) of each row's whole text; a null text has no words."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], pa.int64())],
                                             ["key", "fingerprint"])

    return docs.select(F.col(f"`{key}`").alias("key"), text_or_empty(f"`{text}`").alias("text")).mapInArrow(run, f"key {type_of(docs, key)}, fingerprint long")


def _near(value, bits: int, all_bits: bool):
    """``value`` and what it is with one bit cleared, or with one bit changed."""
    masks = F.array(*[F.lit(1 << b) for b in range(bits)])
    if not all_bits:
        masks = F.filter(masks, lambda m: value.bitwiseAND(m) != 0)
    return F.concat(F.array(value), F.transform(masks, lambda m: value.bitwiseXOR(m)))


def links(classes: DataFrame, fine_above: int = FINE_ABOVE) -> DataFrame:
    """``a, b`` of all different fingerprints with at most three differing bits; ``classes`` has each ``fingerprint`` once."""
    f = F.col("fingerprint")
    high, low = F.shiftrightunsigned(f, 32), f.bitwiseAND(F.lit(LOW))
    segment = F.lit(1 << 32)
    halves = F.array(high, low + segment)
    probes = F.concat(_near(high, 32, False), F.transform(_near(low, 32, False), lambda k: k + segment))
    table = classes.select(f, F.explode(halves).alias("half"))
    probe = classes.select(f, F.explode(probes).alias("half"))
    hot = stored(table.groupBy("half").count().where(F.col("count") > fine_above).select("half", F.lit(True).alias("hot")), "hot_halves")

    def fine(df: DataFrame, ball: bool) -> DataFrame:
        other = F.when(F.col("half") >= segment, high).otherwise(low)
        upper, lower, quarter = F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF)), F.lit(1 << 16)
        keys = F.concat(_near(upper, 16, True), F.transform(_near(lower, 16, True), lambda k: k + quarter)) if ball else F.array(upper, lower + quarter)
        return df.join(hot, "half", "left").select("fingerprint", "half", F.explode(F.when(F.col("hot"), keys).otherwise(F.array(F.lit(-1).cast("long")))).alias("fine"))

    # The planner takes exploded rows for no more than the rows they come from, so it must be told not to broadcast them.
    met = fine(table, False).withColumnRenamed("fingerprint", "x").hint("merge").join(fine(probe, True).withColumnRenamed("fingerprint", "y"), ["half", "fine"])
    differ = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return met.where((F.col("x") != F.col("y")) & (differ <= DISTANCE)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def close_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, copies: DataFrame | None = None) -> DataFrame:
    """``a, b``: keys, unique longs, whose texts' fingerprints are equal or near, enough to connect all of which this is true.

    ``copies``: keys to leave out; fingerprints meet them, as texts would be far more to shuffle.
    """
    own = fingerprints(docs, key, text, width)
    rows = stored(own if copies is None else own.join(copies.toDF("key"), "key", "left_anti"), "fingerprints")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("key").alias("first")), "classes")
    equal = rows.join(classes, "fingerprint").where("key != first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    of = lambda c: classes.select(F.col("fingerprint").alias(c), F.col("first").alias(f"{c}_first"))
    near = links(classes).join(of("a"), "a").join(of("b"), "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    return equal.unionByName(near)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key`` (under its own name but where that is one of the others'), ``fingerprint`` and ``component_id`` for every row; other columns are not read.

    ``component_id`` is the least key reachable over links; null keys do not
    count for it, and it is null where a component has no other.  Texts without
    words all have fingerprint 0.  Repeated rows are rows of the same class.
    """
    rows = stored(fingerprints(docs, key, text, width), "fingerprints")
    classes = stored(rows.groupBy("fingerprint").agg(F.min("key").alias("first")), "classes")
    root = stored(roots(links(classes)), "roots")
    linked = root.join(classes, root.node == classes.fingerprint).select("node", "root", "first")
    merged = root.join(linked.groupBy("root").agg(F.min("first").alias("least")), "root").select(F.col("node").alias("fingerprint"), "least")
    of_class = stored(classes.join(merged, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id")), "components")
    return rows.join(of_class, "fingerprint").select(F.col("key").alias("key" if key in ("fingerprint", "component_id") else key), "fingerprint", "component_id")


def hexadecimal(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
