"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes.  Byte offsets where tokens of both end cut a
text into groups; tokens of a group whose bytes overlap are links.  An id pair's
count is the number of documents that hold it linked.

``same[a]`` is the id of the second vocabulary with the bytes of ``a``.  Pairs
``(a, same[a])`` - nearly all groups of one token each - are counted in one
vector of the first vocabulary's length per task.  Only other pairs enter the
pair shuffle.  Reading the counts back works likewise: vectors and the ``HOT``
most frequent pairs, whose sizes are fixed, are looked up where the documents
are; only rarer pairs are joined, so no key of that join is hot.

Both tokenizers begin a new token at a space between two characters that are not
white space.  Such chunks of text are aligned once and remembered.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, text_or_empty, type_of
from trencher.llm.tokens import _letters, _ranked, default_tokenizer

#: So many of the most frequent pairs are looked up in the documents' tasks at most (16 bytes each).
HOT = 1 << 20
REMEMBER = 200_000
CHARACTERS = 500_000
FLUSH = 1_000_000
CHUNK = re.compile(r"(?<=\S) (?=\S)")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the map of ids with the same bytes (-1: none)."""

    def __init__(self, a: str, b: str):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(a)
        plain.encode_special_tokens = True
        byte = _letters()
        words = sorted(plain.get_vocab().items(), key=lambda w: w[1])
        self.bytes_a = [b""] * (words[-1][1] + 1)
        for word, i in words:
            self.bytes_a[i] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        ranked = _ranked(a)
        self.ids_a = ranked.encode_ordinary if ranked else lambda t: plain.encode(t, add_special_tokens=False).ids
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i), self.b.is_control(i) or self.b.is_unknown(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte, _ in pieces]
        #: Whether no token of the second tokenizer reaches over a space into the next word.
        self.splits = not any("▁" in p.lstrip("▁") for p, _, _ in pieces)
        of: dict[bytes, int] = {}
        for i, (own, (_, is_byte, special)) in enumerate(zip(self.bytes_b, pieces)):
            if not special and (own not in of or not is_byte):
                of[own] = i
        self.same = np.array([of.get(w, -1) if w else -1 for w in self.bytes_a], np.int64)
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)


class Aligner(Vocabularies):
    """Alignments of chunks, each remembered as numbers, a string of its groups and its links' keys ``a * size_b + b``."""

    def __init__(self, a: str, b: str):
        import numpy as np

        super().__init__(a, b)
        self.long_a, self.long_b = (np.array([len(w) for w in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.names_a = np.array([f"{i}{s}" for s in ",|" for i in range(self.size_a)], object)
        self.names_b = np.array([f"{i}{s}" for s in ",;" for i in range(self.size_b)], object)
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[str, int] = {}
        self.names: list[str | None] = []
        self.numbers = np.zeros((0, len(COUNTS)), np.int64)
        self.keys = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def chunks(self, text: str) -> list[str]:
        return CHUNK.split(text) if self.splits else [text]

    def learn(self, chunks: list[str]) -> None:
        """Aligns new chunks; one whose bytes do not come back has the name None."""
        import numpy as np

        ids_a, ids_b = [self.ids_a(" " + c) for c in chunks], self.b.encode(chunks, num_threads=1)
        whole = "".join([" " + c for c in chunks]).encode("utf-8", "surrogatepass")
        joined = lambda ids, words: b"".join([words[i] for own in ids for i in own])
        if joined(ids_a, self.bytes_a) == whole == joined(ids_b, self.bytes_b):
            good = [True] * len(chunks)
        else:
            good = [joined([x], self.bytes_a) == (" " + c).encode("utf-8", "surrogatepass") == joined([y], self.bytes_b) for c, x, y in zip(chunks, ids_a, ids_b)]
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good)] for ids in (ids_a, ids_b))
        flat = lambda ids: np.fromiter((i for own in ids for i in own), np.int64)
        a, b = flat(ids_a), flat(ids_b)
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(chunks)) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        last_a = np.zeros(len(a), bool)
        last_b = np.zeros(len(b), bool)
        if len(a):
            at = np.searchsorted(end_b, end_a)
            last_a = end_b[at] == end_a
            last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # The groups' names: tokens of both in order, those of the first tokenizer before those of the second in each group.
        before_b = np.searchsorted(group_b, group_a)
        before_a = np.searchsorted(group_a, group_b, side="right")
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + before_b] = self.names_a[a + last_a * self.size_a]
        names[np.arange(len(b)) + before_a] = self.names_b[b + last_b * self.size_b]
        cuts = np.cumsum(np.concatenate([[0], n_a + n_b])).tolist()
        names = names.tolist()
        # Links: from the first token that ends after this one's start to the first that ends at its end or later.
        first = np.searchsorted(end_b, end_a - self.long_a[a], side="right")
        many = np.searchsorted(end_b, end_a) - first + 1
        to = np.cumsum(many)
        keys = np.repeat(a, many) * self.size_b + b[np.arange(to[-1] if len(to) else 0) - np.repeat(to - many - first, many)]
        ends_a, done = np.cumsum(n_a), np.concatenate([[0], to])
        groups = np.concatenate([[0], np.cumsum(last_a)])
        starts_a = ends_a - n_a
        n_links, n_groups = done[ends_a] - done[starts_a], groups[ends_a] - groups[starts_a]
        for c, i, j, ok in zip(chunks, cuts, cuts[1:], good):
            self.known[c] = len(self.names)
            self.names.append("".join(names[i:j]) if ok else None)
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.keys = np.concatenate([self.keys, keys])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])

    def align(self, texts: list[str]):
        """Counts (one row per text), digests, and per text its distinct links' keys with their numbers, as ``(ends, keys, n)``."""
        import numpy as np

        if len(self.known) > REMEMBER or len(self.keys) > 16 * REMEMBER:
            self.forget()
        parts = [self.chunks(t) if t else [] for t in texts]
        if new := list({c for own in parts for c in own if c not in self.known}):
            self.learn(new)
        numbers, digests = np.zeros((len(texts), len(COUNTS)), np.int64), []
        met = []
        for k, own in enumerate(parts):
            met.append(np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)))
            try:
                name = "".join([self.names[i] for i in met[-1].tolist()])
            except TypeError:  # a chunk whose bytes do not come back
                met[-1] = met[-1][:0]
                name = ""
            digests.append(hashlib.sha256(name[:-1].encode()).hexdigest() if name else "")
            numbers[k] = self.numbers[met[-1]].sum(0)
        at = np.concatenate(met) if met else np.zeros(0, np.int64)
        many = self.ends[at + 1] - self.ends[at]
        to = np.cumsum(many)
        keys = self.keys[np.arange(to[-1] if len(to) else 0) - np.repeat(to - many - self.ends[at], many)]
        text = np.repeat(np.repeat(np.arange(len(texts)), [len(m) for m in met]), many)
        span = self.size_a * self.size_b
        pairs, n = np.unique(text * span + keys, return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(texts) + 1) * span)
        return numbers, digests, ends, pairs % span, n


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: ``row, key``, the four counts, ``groups_sha256`` and its distinct links as bytes.

    ``same_a, same_n``: first ids (32 bits) of pairs in the identity map and how
    often each is linked; ``pair, pair_n``: keys ``a * size_b + b`` (64 bits) and
    numbers (32 bits) of all other pairs.
    """
    a, b, kind = a or default_tokenizer(), b or default_pieces(), type_of(docs, key)
    fields = ["row", key, *COUNTS, "groups_sha256", "same_a", "same_n", "pair", "pair_n"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        aligner = Aligner(a, b)
        for batch in batches:
            sizes, at = batch.column(2).to_pylist(), 0
            while at < batch.num_rows:
                to, n = at, 0
                while to < batch.num_rows and (to == at or n + sizes[to] <= CHARACTERS):
                    n += sizes[to]
                    to += 1
                part = batch.slice(at, to - at)
                at = to
                numbers, digests, ends, pairs, n = aligner.align(part.column(3).to_pylist())
                first, second = pairs // aligner.size_b, pairs % aligner.size_b
                known = aligner.same[first] == second
                columns = [[], [], [], []]
                for i, j in zip(ends, ends[1:]):
                    own = known[i:j]
                    for column, values, which, kind_ in zip(columns, (first, n, pairs, n), (own, own, ~own, ~own), ("<u4", "<u4", "<i8", "<u4")):
                        column.append(values[i:j][which].astype(kind_).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(c) for c in numbers.T], pa.array(digests, pa.string()), *[pa.array(c, pa.binary()) for c in columns]], fields)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias(key), text_or_empty(f"`{text}`").alias("text"))
    given = given.select("row", key, F.length("text").alias("n_chars"), "text")
    return given.mapInArrow(run, f"row long, `{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) +
                            ", groups_sha256 string, same_a binary, same_n binary, pair binary, pair_n binary")


def _partial_counts(found: DataFrame, size_a: int) -> DataFrame:
    """``known, key, n``: documents per first id of the identity map (one vector a task), and per other pair, in part."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        vector, kept, n = np.zeros(size_a, np.int64), [], 0

        def rows(known, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), known)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["known", "key", "n"])

        for batch in batches:
            for same, pair in zip(*(c.to_pylist() for c in batch.columns)):
                vector[np.frombuffer(same, "<u4")] += 1  # each id once
                kept.append(np.frombuffer(pair, "<i8"))
                n += len(kept[-1])
                if n > FLUSH:
                    yield rows(False, *np.unique(np.concatenate(kept), return_counts=True))
                    kept, n = [], 0
        if kept:
            yield rows(False, *np.unique(np.concatenate(kept), return_counts=True))
        own = np.nonzero(vector)[0]
        yield rows(True, own, vector[own])

    return found.select("same_a", "pair").mapInArrow(run, "known boolean, key long, n long")


def _vector(rows: DataFrame, size: int):
    """A vector of ``size`` numbers from rows ``key, n``, at most one of each key below ``size``."""
    import numpy as np

    out = np.zeros(size, np.int64)
    got = rows.select("key", "n").toArrow()
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out


def _frequent(pairs: DataFrame, hot: int):
    """The least count, a power of two, that at most ``hot`` pairs reach."""
    power = F.floor(F.log2(F.col("n").cast("double")))
    of = {int(r["power"]): r["pairs"] for r in pairs.groupBy(power.alias("power")).agg(F.count("*").alias("pairs")).collect()}  # at most 64 rows
    least, n = max(of, default=0) + 1, 0
    while least > 0 and n + of.get(least - 1, 0) <= hot:
        least -= 1
        n += of.get(least, 0)
    return 1 << least


def alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None, hot: int | None = None) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    ``n_best``: links whose pair's count is the highest of its first id in the
    corpus, ties included; ``count_sum``: the counts of all links.  A text that
    is null or empty, or whose bytes do not come back from both tokenizers, has
    no tokens: zeros and an empty digest.  Repeated rows and null keys are rows
    of their own; other columns are not read; an empty table gives an empty one.
    """
    import numpy as np

    vocabularies = Vocabularies(a or default_tokenizer(), b or default_pieces())
    size_a, size_b = vocabularies.size_a, vocabularies.size_b
    found = stored(aligned(docs, key, text, a, b), "aligned")
    parts = stored(_partial_counts(found, size_a), "partial_counts")
    summed = lambda known: parts.where(F.col("known") == known).groupBy("key").agg(F.sum("n").alias("n"))
    same = _vector(summed(True), size_a)
    pairs = stored(summed(False), "pair_counts")
    best = np.maximum(same, _vector(pairs.groupBy(F.expr(f"key DIV {size_b}").alias("key")).agg(F.max("n").alias("n")), size_a))
    least = _frequent(pairs, HOT if hot is None else hot)
    top = pairs.where(F.col("n") >= least).toArrow()  # `hot` rows at most
    order = np.argsort(top["key"].to_numpy())
    keys, counts = top["key"].to_numpy()[order], top["n"].to_numpy()[order]

    def known(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = batch.to_pydict()
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, (ids, n, pair, m) in enumerate(zip(table["same_a"], table["same_n"], table["pair"], table["pair_n"])):
                ids, n, pair, m = np.frombuffer(ids, "<u4"), np.frombuffer(n, "<u4").astype(np.int64), np.frombuffer(pair, "<i8"), np.frombuffer(m, "<u4").astype(np.int64)
                at, is_hot = _places(keys, pair)
                of = np.where(is_hot, counts[at], 0) if len(keys) else np.zeros(len(pair), np.int64)
                n_best[k] = n[same[ids] == best[ids]].sum() + m[is_hot & (of == best[pair // size_b])].sum()
                total[k] = (n * same[ids]).sum() + (m * of).sum()
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 4)] + [pa.array(n_best), pa.array(total)],
                                             [*batch.schema.names[:-4], "n_best", "count_sum"])

    def rare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row, pair, m in zip(*(c.to_pylist() for c in batch.columns)):
                pair, m = np.frombuffer(pair, "<i8"), np.frombuffer(m, "<u4")
                left = ~_places(keys, pair)[1]
                if left.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(left.sum(), row, np.int64)), pa.array(pair[left]), pa.array(m[left].astype(np.int64))], ["row", "key", "m"])

    kind = type_of(docs, key)
    out = found.mapInArrow(known, f"row long, `{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, n_best long, count_sum long")
    if least > 1:
        highest = docs.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(best) if n], "a int, highest long")
        tail = pairs.where(F.col("n") < least).withColumn("a", F.expr(f"CAST(key DIV {size_b} AS INT)"))
        tail = tail.join(F.broadcast(highest), "a").select("key", "n", (F.col("n") == F.col("highest")).alias("top"))  # a row per id of the vocabulary at most
        more = found.select("row", "pair", "pair_n").mapInArrow(rare, "row long, key long, m long").join(tail, "key")
        more = more.groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("m")).otherwise(0)).alias("best_"), F.sum(F.col("m") * F.col("n")).alias("sum_"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_", F.lit(0))})
    return out.select(key, *COUNTS, "n_best", "count_sum", "groups_sha256")


def _places(keys, wanted):
    """Where sorted ``keys`` hold each wanted one, and whether they do."""
    import numpy as np

    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
