"""Best-fit packing, planned on the histogram of lengths.

``token_pieces`` cuts documents into pieces, ``pack`` gives each piece its place
and ``sequences`` builds the packed sequences.

The plan sees only how many pieces there are of each length, at most
``capacity`` numbers: best fit in order of falling length moves whole groups of
sequences with equal room at a time, so its size depends on ``capacity`` and not
on the corpus.  A piece finds its place by its rank among the pieces of its
length.  Ranks come from counts by (length, part of the stored table), so no
task sees all pieces of a frequent length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trencher.llm.shared import given, stored, text_or_empty, type_of, whole_row
from trencher.llm.tokens import ID_BYTES, Encoder

CAPACITY = 2048
END_ID = 0
BATCH = 500
PLACES = ["sequence_id", "offset"]
PLAN_COLUMNS = ["length", "first_rank", "n", "first_sequence", "room_at", "per_sequence"]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all of ``capacity`` but for a shorter first one."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
                 tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (little-endian uint32 bytes).

    Null and empty texts are the end id alone.  Rows are taken as they come, so
    repeated rows and null ids give pieces of their own; other columns are not read.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(ID_BYTES, "little")

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = ([], [], [], [], [])
                for i, ids in enumerate(encoder.encode(part.column(1).to_pylist())):
                    ids += end
                    if not ids:
                        continue
                    for piece, (start, n) in enumerate(cut(len(ids) // ID_BYTES, capacity)):
                        for out, v in zip(rows, (i, piece, start, n, ids[start * ID_BYTES:(start + n) * ID_BYTES])):
                            out.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows[0], pa.int32())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
                     pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"doc_id {type_of(docs, doc_id)}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Best fit over counts, longest first: rows of ``PLAN_COLUMNS``.

    A row places the ``n`` pieces of ``length`` from rank ``first_rank`` on,
    ``per_sequence`` of them one after the other in each sequence from
    ``first_sequence`` on, the first at offset ``room_at``.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: groups (first sequence, number)
    rooms: list[int] = []  # sorted
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                n = max(1, left // (capacity // length))
                put(capacity, made, n)
                made += n
                continue
            room = rooms[at]
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            per = min(left, room // length)
            m = min(n, left // per)
            yield length, rank, m * per, first, capacity - room, per
            rank += m * per
            left -= m * per
            put(room, first + m, n - m)
            put(room - per * length, first, m)


def numbered(df: DataFrame, length: str) -> DataFrame:
    """Adds ``part`` and ``rank_in_part``: the row's number among those of its length in its task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            n = batch.column(length).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(n) and n.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(n.max() + 1 - len(seen), np.int64)])
            order = np.argsort(n, kind="stable")
            values, first, count = np.unique(n[order], return_index=True, return_counts=True)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, count) + np.repeat(seen[values], count)
            seen[values] += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(rank)],
                                             [*batch.schema.names, "part", "rank_in_part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, part long, rank_in_part long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (from 0, without gaps).

    Lengths must be from 1 to ``capacity``; rows of null length get null places.
    Ties and repeated rows are pieces of their own; an empty table gives an empty
    table.  Columns of the given table named as these two are replaced.
    """
    import pyarrow as pa

    spark = pieces.sparkSession
    sized = stored(numbered(pieces.select(whole_row(pieces.columns).alias("row"), F.col(f"`{length}`").cast("long").alias("length")), "length"), "pieces")
    counts = stored(sized.where("length IS NOT NULL").groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = list(zip(*plan(histogram, capacity))) or [()] * len(PLAN_COLUMNS)
    slots = spark.createDataFrame(pa.table([pa.array(r, pa.int64()) for r in rows], PLAN_COLUMNS)).withColumnRenamed("length", "of_length")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("length").alias("own_length"), F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = sized.join(firsts, (F.col("length") == F.col("own_length")) & (F.col("part") == F.col("own_part"))).withColumn("rank", F.col("first") + F.col("rank_in_part"))
    nth = F.col("rank") - F.col("first_rank")
    # The plan's size depends on `capacity` alone.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("of_length")) & (nth >= 0) & (nth < F.col("n")))
    own = given(pieces.columns, PLACES)
    placed = placed.select(*own, (F.col("first_sequence") + F.floor(nth / F.col("per_sequence"))).cast("long").alias("sequence_id"),
                           (F.col("room_at") + nth % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"))
    none = F.lit(None).cast("long")
    return placed.unionByName(sized.where("length IS NULL").select(*own, *[none.alias(c) for c in PLACES]))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids``, at most ``capacity`` ids each."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
