"""Benchmark decontamination: a prefix-filtered set join.

A window (13 consecutive words of a benchmark item, or a shorter item whole) is
a set of 3-word shingles with positions.  Containment needs all of them, so one
shingle is the necessary prefix: the rarest, by counts over all documents.  Only
documents' occurrences of prefix shingles are joined.  An occurrence at word
``p`` of the shingle at offset ``o`` puts the window at ``p - o``: it must lie
within the document, and its words are compared with the document's.

Shingles travel as 64-bit hashes and meet a bitmap of fixed size before any
shuffle; both only save work, as every match is verified word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, text_or_empty, type_of

SIZE = 13
WIDTH = 3
FILTER_BITS = 1 << 22
FLUSH = 200_000
UPPER = bytes(range(65, 91))
_KEPT = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TO_WORDS = bytes(b + 32 if b in UPPER else b if b in _KEPT else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class WordHashes(dict):
    """Hashes of words, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


def shingle_hashes(known: WordHashes, words: list[bytes], width: int):
    """The hash of the ``width`` words from each position on."""
    import numpy as np

    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(0, len(words) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """``item_id, words, shingles``: each item's windows as space-joined words, with their shingles' hashes in order.

    Items without words, or of null text, have none.
    """
    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            item, joined, hashes = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = words_of(t)
                for at in range(max(1, len(w) - size + 1) if w else 0):
                    own = w[at:at + size]
                    item.append(i)
                    joined.append(b" ".join(own).decode("utf-8", "surrogatepass"))
                    hashes.append(shingle_hashes(known, own, min(width, len(own))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(item, pa.int32())), pa.array(joined, pa.string()),
                                              pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "words", "shingles"])

    return benchmark.select(F.col(item_id).alias("item_id"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"item_id {type_of(benchmark, item_id)}, words string, shingles array<long>")


def _bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of ``FILTER_BITS`` with two bits for each ``shingle``; built in groups of 64, so its size is fixed."""
    import numpy as np

    at = F.explode(F.array(F.pmod("shingle", F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned("shingle", 32), F.lit(FILTER_BITS))))
    rows = hashes.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("i").to_numpy()] = rows.column("bits").to_numpy()
    return out.tobytes()


def _may_match(hashes, bitmap):
    import numpy as np

    h = hashes.view(np.uint64)
    size = np.uint64(FILTER_BITS)
    first, second = h % size, (h >> np.uint64(32)) % size
    hit = lambda at: (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return np.nonzero(hit(first) & hit(second))[0]


def _frequencies(docs: DataFrame, bits: bytes, widths: list[int]) -> DataFrame:
    """``shingle, df``: occurrences in all documents of the shingles in the bitmap."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        bitmap, known, kept, n = np.frombuffer(bits, np.uint8), WordHashes(), [], 0

        def counted():
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for t in batch.column(1).to_pylist():
                w = words_of(t)
                for width in widths:
                    h = shingle_hashes(known, w, width)
                    h = h[_may_match(h, bitmap)]
                    if len(h):
                        kept.append(h)
                        n += len(h)
                if n > FLUSH:
                    yield counted()
                    kept, n = [], 0
        if kept:
            yield counted()

    return docs.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))


def _occurrences(docs: DataFrame, bits: bytes, widths: list[int], size: int) -> DataFrame:
    """``key, row_part, row_no, n_words, found``: where each document may hold a prefix shingle, with the words around it."""
    key, kind = docs.columns[0], docs.schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        bitmap, known, part, row = np.frombuffer(bits, np.uint8), WordHashes(), TaskContext.get().partitionId(), 0
        item = pa.list_(pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("lead", pa.int32()), ("around", pa.string())]))
        for batch in batches:
            n_words, found = [], []
            for t in batch.column(1).to_pylist():
                w = words_of(t)
                n_words.append(len(w))
                own = []
                for width in widths:
                    h = shingle_hashes(known, w, width)
                    for p in _may_match(h, bitmap).tolist():
                        lead = min(p, size - width)
                        own.append({"at": p, "shingle": int(h[p]), "lead": lead, "around": b" ".join(w[p - lead:p + size]).decode("utf-8", "surrogatepass")})
                found.append(own)
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(rows), pa.array(n_words, pa.int64()),
                                              pa.array(found, item)], [key, "row_part", "row_no", "n_words", "found"])

    return docs.mapInArrow(run, f"`{key}` {kind}, row_part long, row_no long, n_words long, found array<struct<at: int, shingle: long, lead: int, around: string>>")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, width: int = WIDTH,
                  percent: int = 5) -> DataFrame:
    """``key, n_words, spans, items, n_hit, contaminated`` for every row of ``docs``.

    ``spans``: (start, n) in words of every occurrence of a window; ``items``:
    ids, as sorted strings, of the items with occurring windows (a null id is an
    empty string); ``n_hit``: words inside any occurrence; ``contaminated``: at
    least ``percent`` of the words.  Repeated rows and null keys are rows of
    their own; texts without words have no hits; without items nothing is hit.
    """
    docs = docs.select(key, text_or_empty(text).alias("text"))
    windows_ = stored(windows(benchmark, size=size, width=width), "windows")
    sets = windows_.select("words", "shingles").distinct().select("words", F.size(F.split("words", " ")).alias("n"), F.posexplode("shingles").alias("offset", "shingle"))
    widths = sorted(r[0] for r in sets.select(F.least(F.col("n"), F.lit(width))).distinct().collect())  # at most `width` numbers
    counts = stored(_frequencies(docs, _bitmap(sets), widths), "frequencies")
    # A window with a shingle that no document has cannot occur.
    rarest = sets.join(counts, "shingle", "left").groupBy("words", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "shingle")).alias("least")).where("least.df > 0")
    prefixes = stored(rarest.select("words", "n", "least.offset", "least.shingle"), "prefixes")
    rows = stored(_occurrences(docs, _bitmap(prefixes), widths, size), "occurrences")
    row = ["row_part", "row_no"]
    found = rows.where(F.size("found") > 0).select(*row, "n_words", F.inline("found"))
    start = F.col("at") - F.col("offset")
    hits = found.join(prefixes, "shingle").where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("lead") >= F.col("offset")))
    hits = hits.where(F.array_join(F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("n")), " ") == F.col("words"))
    hits = stored(hits.select(*row, start.alias("start"), F.col("n").cast("int").alias("n"), "words"), "hits")
    spans = hits.select(*row, "start", "n").distinct().groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    items = hits.select(*row, "words").distinct().join(windows_.select("words", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")), "words")
    items = items.groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.expr("aggregate(spans, named_struct('to', 0, 'n', 0L), (a, s) -> named_struct('to', greatest(a.to, s.start + s.n), "
                   "'n', a.n + greatest(0, s.start + s.n - greatest(a.to, s.start))), a -> a.n)")
    out = rows.drop("found").join(spans, row, "left").join(items, row, "left")
    out = out.withColumn("n_hit", F.coalesce(n_hit, F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(key, "n_words", "spans", "items", "n_hit",
                      ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))
