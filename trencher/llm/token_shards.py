"""Training-order materialisation of token sequences.

Sequences are numbered 0 to N-1; a keyed Feistel permutation of the next power
of four, walked along its cycle until it lands below N, gives each number its
slot in the training order.  Ranges of slots are written as shards of records of
one stride, so slot ``s`` is record ``s % per_shard`` of shard ``s // per_shard``
and a reader resumes anywhere by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.packing import numbered, token_pieces
from trencher.llm.shared import stored, type_of

LENGTH = 1024
PER_SHARD = 1024
KEY = 20_240_601
ROUNDS = 6
RECORD_ID_BYTES = 2


def permuted(index, n: int, key: int = KEY):
    """Slots of the numbers ``index``, an array of ints below ``n``."""
    import numpy as np

    bits = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)

    def once(x):
        left, right = x >> np.uint64(bits), x & mask
        for r in range(ROUNDS):
            h = (right ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9) % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        return (left << np.uint64(bits)) | right

    out = once(np.asarray(index, np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, length, ids``: each document's ids and end id in pieces of ``length`` at most, as little-endian uint16."""
    def narrow(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            if any(len(x) and x.max() >> 8 * RECORD_ID_BYTES for x in ids):
                raise ValueError("an id is too large for a record")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("length"), pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())],
                                             ["doc_id", "piece", "length", "ids"])

    pieces = token_pieces(docs, length, doc_id, text, tokenizer)
    return pieces.select("doc_id", "piece", "length", "ids").mapInArrow(narrow, f"doc_id {type_of(pieces, 'doc_id')}, piece int, length long, ids binary")


def shards(seqs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """One row per shard: ``shard, doc_ids, pieces, lengths, payload``; record ``k`` of the payload starts at ``k * length * 2``.

    Every sequence has a slot, repeated ones too; records are padded with zeros,
    and ``lengths`` has their ids.  No sequences make no shards.
    """
    stride = length * RECORD_ID_BYTES
    rows = stored(numbered(seqs.withColumn("one", F.lit(0)), "one").drop("one"), "sequences")
    # One row for each task that numbered rows.
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    first, n = {}, 0
    for part, count in counts:
        first[part] = n
        n += count

    def slotted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            index = np.fromiter(map(first.__getitem__, batch.column("part").to_pylist()), np.int64, batch.num_rows) + batch.column("rank_in_part").to_numpy()
            slot = permuted(index, n, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), *[batch.column(c) for c in ("doc_id", "piece", "length", "ids")]],
                                             ["shard", "slot", "doc_id", "piece", "length", "ids"])

    kind = type_of(seqs, "doc_id")
    placed = rows.mapInArrow(slotted, f"shard long, slot long, doc_id {kind}, piece int, length long, ids binary")
    partitions = max(1, min(-(-n // per_shard), int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def written(batches):
        import pyarrow as pa

        names = ["shard", "doc_ids", "pieces", "lengths", "payload"]
        shard, kept = None, []

        def row():
            columns = [[shard], [[r[0] for r in kept]], [[r[1] for r in kept]], [[r[2] for r in kept]], [b"".join(r[3].ljust(stride, b"\0") for r in kept)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            kinds = [pa.int64(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            for s, *r in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "length", "ids"))):
                if kept and s != shard:
                    yield row()
                    kept = []
                shard = s
                kept.append(r)
        if kept:
            yield row()

    ordered = placed.repartitionByRange(partitions, "shard").sortWithinPartitions("slot")
    return stored(ordered.mapInArrow(written, f"shard long, doc_ids array<{kind}>, pieces array<int>, lengths array<long>, payload binary"), "shards")


def records(written: DataFrame, from_slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """``slot, shard, byte_offset, doc_id, piece, length, ids`` read back from the shards' payloads, from a slot on; order by ``slot`` to train."""
    stride = length * RECORD_ID_BYTES
    r = written.where(F.col("shard") >= from_slot // per_shard).select("shard", "payload", F.posexplode(F.arrays_zip("doc_ids", "pieces", "lengths")).alias("k", "r"))
    r = r.select((F.col("shard") * per_shard + F.col("k")).alias("slot"), "shard", (F.col("k") * stride).cast("long").alias("byte_offset"), F.col("r.doc_ids").alias("doc_id"),
                 F.col("r.pieces").alias("piece"), F.col("r.lengths").alias("length"),
                 F.expr(f"substring(payload, CAST(k * {stride} + 1 AS INT), CAST(r.lengths * {RECORD_ID_BYTES} AS INT))").alias("ids"))
    return r.where(F.col("slot") >= from_slot)
