"""Sharding by extendible hashing.

The directory is indexed by leading bits of a hash of the key.  A bucket that
holds more bytes than the limit splits on its next bit, others stay, so shards
differ in depth.  Sums over fine prefixes decide all splits of a round at once;
rows of buckets still too large go on to the next bits.  When the bits of the key
are used up, as for one key with very many rows, bits of a row number follow.  A
row that alone is larger than the limit is a shard of its own.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import folder, given, stored, whole_row

LIMIT = 8 << 20
STEP = 16
WORD = 64
OUTPUTS = ["shard", "depth", "n_bytes", "shard_bytes"]


def _bits(hash_, at: int, n: int):
    return F.shiftrightunsigned(hash_, WORD - at - n).bitwiseAND(F.lit((1 << n) - 1))


def _leaves(rows: DataFrame, bits: int, limit: int) -> DataFrame:
    """``path_, cell_, depth_, shard_bytes`` of every cell of ``rows(path_, cell_, bytes_)`` that lies in a bucket within the limit."""
    cells = stored(rows.groupBy("path_", "cell_").agg(F.sum("bytes_").alias("b"), F.count("*").alias("n")), "cells")
    levels = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth_")
    up = cells.select("path_", "cell_", "b", "n", levels).withColumn("node_", F.expr(f"shiftright(cell_, {bits} - depth_)"))
    node = ["path_", "depth_", "node_"]
    fit = up.groupBy(*node).agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows")).where((F.col("bytes") <= limit) | (F.col("rows") == 1))
    least = up.join(fit, node).groupBy("path_", "cell_").agg(F.min(F.struct("depth_", "bytes")).alias("x"))
    return stored(least.select("path_", "cell_", "x.depth_", F.col("x.bytes").alias("shard_bytes")), "leaves")


def assigned(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``shard`` (its prefix in 0 and 1), ``depth``, ``n_bytes`` and ``shard_bytes``.

    A null text has no bytes; null keys hash alike and split by row number;
    repeated rows are rows of their own.  Columns of the given table named as one
    of these four are replaced.
    """
    sized = docs.select(whole_row(docs.columns).alias("row"), F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long").alias("bytes_"),
                        F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("hash_"))
    total = sized.agg(F.sum("bytes_")).first()[0] or 0
    bits = min(WORD - STEP, max(4, ceil(log2(total / limit + 1)) + 4))
    rows = sized.withColumn("path_", F.lit("")).withColumn("cell_", _bits(F.col("hash_"), 0, bits))
    done, at, word = None, 0, 0

    def split(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
        leaf = _leaves(rows.select("path_", "cell_", "bytes_"), bits, limit)
        cells = ["path_", "cell_"]
        found = rows.join(leaf, cells).select("row", F.concat("path_", F.expr(f"left(lpad(bin(cell_), {bits}, '0'), depth_)")).alias("shard"),
                                              F.col("bytes_").alias("n_bytes"), "shard_bytes").withColumn("depth", F.length("shard"))
        return found, rows.join(leaf, cells, "left_anti").withColumn("path_", F.concat("path_", F.expr(f"lpad(bin(cell_), {bits}, '0')")))

    while True:
        found, rest = split(rows, bits)
        done = found if done is None else done.unionByName(found)
        rest = stored(rest if word or at else rest.withColumn("row_", F.xxhash64(F.monotonically_increasing_id())), "rest")
        if rest.isEmpty():
            return done.select(*given(docs.columns, OUTPUTS), *OUTPUTS)
        at += bits
        if at >= WORD:
            at, word = 0, word + 1
            if word > 1:
                raise ValueError("rows with equal hashes of key and row number")
        bits = min(STEP, WORD - at)
        rows = rest.withColumn("cell_", _bits(F.col("row_" if word else "hash_"), at, bits))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Writes ``docs`` to ``path``, a folder ``shard=p...`` for each shard."""
    out = assigned(docs, key, text, limit).withColumn("shard", F.concat(F.lit("p"), "shard"))
    out.repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    from uuid import uuid4

    path = f"{folder(docs.sparkSession)}/trencher/{uuid4().hex}/shards"
    write_shards(docs, path, key, text, limit)
    extra = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in OUTPUTS)
    return docs.sparkSession.read.schema(f"{extra}, depth int, n_bytes long, shard_bytes long, shard string").parquet(path).withColumn("shard", F.substring("shard", 2, 2 * WORD))
