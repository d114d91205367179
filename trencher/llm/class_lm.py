"""A class-based bigram model over whole corpora: exchange clustering, then P(class | class) * P(word | class).

1. Texts are coded once into blocks: rows of a bounded number of tokens with
   their own vocabulary.  All further passes work on the codes.
2. Words are counted over all training texts.
3. The ``core`` most frequent words are clustered by exchange on their bigram
   counts, a table whose size ``core`` bounds.  Every other word makes one
   exchange step: it joins the class that its neighbours' classes favour, from
   its counts over all training texts.
4. A block fetches counts and classes of its own words by a join; transitions
   are counted over all training texts, and texts are scored.

Emissions and transitions are smoothed additively.  Unknown words are one more
type that each class emits as a word of count 0; after one, the state is the
class most likely to have emitted it, so that the probabilities of what may
come next always add up to 1.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, text_or_empty, type_of

CLASSES = 16
CORE = 1000
BLOCK_TOKENS = 2_000_000
FLUSH_WORDS = 500_000
SWEEPS = 20
EMISSION, TRANSITION = 1.0, 0.5
FOLDS, HELD_OUT = 7, 2
UNKNOWN = 255


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text, modulo 7, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class _Codes(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def coded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per block: ``block, words, n_train, doc_ids, held, sizes, codes`` (uint32 bytes, an index into ``words`` per word).

    A null text is empty.  A block ends with the text that fills it, so only a
    longer text makes a longer block.
    """
    kind = type_of(docs, doc_id)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["block", "words", "n_train", "doc_ids", "held", "sizes", "codes"]
        block = TaskContext.get().partitionId() << 32
        words, ids, held, parts = _Codes(), [], [], []

        def row():
            codes = np.concatenate(parts)
            sizes = [len(p) for p in parts]
            n = np.bincount(codes, weights=np.repeat(~np.array(held, bool), sizes), minlength=len(words)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (
                pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()), pa.array(n), pa.array(ids, kind_), pa.array(held, pa.bool_()), pa.array(sizes, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([codes.tobytes()], pa.binary())], names)

        total = 0
        for batch in batches:
            kind_ = batch.schema.field(0).type
            for i, h, t in zip(*(c.to_pylist() for c in batch.columns)):
                own = t.encode("utf-8", "surrogatepass").lower().split()
                parts.append(np.fromiter(map(words.__getitem__, own), np.uint32, len(own)))
                ids.append(i)
                held.append(h)
                total += len(own)
                if total >= block_tokens or len(parts) >= block_tokens:
                    yield row()
                    block += 1
                    words, ids, held, parts, total = _Codes(), [], [], [], 0
        if parts:
            yield row()

    return docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"block long, words array<string>, n_train array<long>, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, codes binary")


def _lists(batch, name: str):
    """The lists of a column, one Arrow array a row."""
    return [x.values for x in batch.column(name)]


def _numbered(words, core: list[str], numbers, other: int):
    """The number of each word that is in the core; ``other`` for the rest."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at = pc.index_in(words, value_set=pa.array(core, pa.string())).fill_null(len(core)).to_numpy(zero_copy_only=False)
    return np.append(np.array(numbers, np.int64), other)[at]


def _streams(codes: bytes, sizes, held, of_word, boundary: int):
    """Training texts of a block as classes (or ids) with a boundary before the first, between any two and after the last, and each one's code (-1)."""
    import numpy as np

    codes = np.frombuffer(codes, np.uint32).astype(np.int64)
    sizes, train = sizes.to_numpy().astype(np.int64), ~held.to_numpy(zero_copy_only=False).astype(bool)
    codes, sizes = codes[np.repeat(train, sizes)], sizes[train]
    at = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes) + 1
    own = np.full(len(codes) + len(sizes) + 1, -1, np.int64)
    own[at] = codes
    return np.where(own < 0, boundary, of_word[own] if len(of_word) else boundary), own


def _blocks_of(batch):
    return zip(_lists(batch, "words"), batch.column("codes").to_pylist(), _lists(batch, "sizes"), _lists(batch, "held"))


def _pair_counts(blocks: DataFrame, core: list[str]) -> DataFrame:
    """``pair, n``: how often id ``pair % size`` follows id ``pair // size`` in training texts; after the core's ids come other words and the boundary."""
    other, boundary = len(core), len(core) + 1
    size = boundary + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for words, codes, sizes, held in _blocks_of(batch):
                ids, _ = _streams(codes, sizes, held, _numbered(words, core, range(len(core)), other), boundary)
                pairs, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    return blocks.select("words", "held", "sizes", "codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _matrix(counts: DataFrame, size: int):
    """``pair, n`` as a matrix; at most ``size`` squared rows come to the driver."""
    import numpy as np

    found = counts.toArrow()
    out = np.zeros(size * size)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def exchange(pairs, classes: int, sweeps: int = SWEEPS):
    """Classes of words 0 to n-3 given bigram counts; the last two ids are the other words and the boundary, each a class of its own.

    Words move, most frequent first, to the class with which the likelihood of
    the class bigrams is highest, until none moves.
    """
    import numpy as np

    n = len(pairs) - 2
    own = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    member = np.eye(classes + 2)[own]
    counts = member.T @ pairs @ member
    f = lambda x: x * np.log(np.maximum(x, 1))
    k = np.arange(classes)
    for _ in range(sweeps):
        moved = False
        for w in range(n):
            loop = pairs[w, w]
            after = np.bincount(own, weights=pairs[w], minlength=classes + 2)
            before = np.bincount(own, weights=pairs[:, w], minlength=classes + 2)
            c = own[w]
            after[c] -= loop
            before[c] -= loop
            counts[c] -= after
            counts[:, c] -= before
            counts[c, c] -= loop
            rows, columns = counts[:classes], counts[:, :classes].T
            new_rows, new_columns = rows + after, columns + before
            both = counts[k, k] + after[k] + before[k] + loop
            gain = (f(new_rows) - f(rows)).sum(1) + (f(new_columns) - f(columns)).sum(1)
            gain += f(both) + f(counts[k, k]) - f(new_rows[k, k]) - f(new_columns[k, k])
            gain -= f(rows.sum(1) + after.sum() + loop) - f(rows.sum(1)) + f(columns.sum(1) + before.sum() + loop) - f(columns.sum(1))
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved |= best != c
            own[w] = best
            counts[best] += after
            counts[:, best] += before
            counts[best, best] += loop
        if not moved:
            break
    return own[:n], counts


def _contexts(blocks: DataFrame, core: list[str], of_core: list[int], classes: int) -> DataFrame:
    """``word, found``: for words outside the core, a number ``context << 48 | n`` for each class before (its number) and after (more by ``classes + 2``).

    Neighbours outside the core say nothing and are left out; a task adds up its
    blocks and passes the sums on whenever it has many words.
    """
    other, boundary, span = classes, classes + 1, classes + 2

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def passed_on():
            names = np.array(list(known), object)
            word, first = np.unique(keys // (2 * span), return_index=True)
            found = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), pa.array((keys % (2 * span) << 48) | sums))
            return pa.RecordBatch.from_arrays([pa.array(names[word].tolist(), pa.string()), found], ["word", "found"])

        known, keys, sums = _Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for words, codes, sizes, held in _blocks_of(batch):
                ids, own = _streams(codes, sizes, held, _numbered(words, core, of_core, other), boundary)
                at = np.nonzero(ids == other)[0]
                local = own[at] * 2 * span
                key = np.concatenate([local + ids[at - 1], local + span + ids[at + 1]])
                key, n = np.unique(key[key % span != other], return_counts=True)
                used, back = np.unique(key // (2 * span), return_inverse=True)
                task = np.fromiter(map(known.__getitem__, words.take(pa.array(used)).to_pylist()), np.int64, len(used))
                keys, back = np.unique(np.concatenate([keys, task[back] * 2 * span + key % (2 * span)]), return_inverse=True)
                sums = np.bincount(back, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
                if len(known) > FLUSH_WORDS:
                    yield passed_on()
                    known, keys, sums = _Codes(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield passed_on()

    return blocks.select("words", "held", "sizes", "codes").mapInArrow(run, "word string, found array<long>")


def _steps(contexts: DataFrame, counts, classes: int) -> DataFrame:
    """``word, class`` by one exchange step of each word, from all its rows of ``contexts``."""
    import numpy as np

    span = classes + 2
    after = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # P(next | previous)
    share = np.log((counts.sum(0) + 1) / (counts.sum() + span))
    gain = np.concatenate([np.log(after) - share, (np.log(after) - share).T])[:, :classes]  # context by class

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def best(words, score):
            return pa.RecordBatch.from_arrays([words, pa.array(score.argmax(1), pa.int32())], ["word", "class"])

        last, open_score = None, None  # the rows of a word may go on in the next batch
        for batch in batches:
            words, found = batch.column("word"), batch.column("found")
            if not len(words):
                continue
            fresh = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False).astype(bool))
            group = np.cumsum(fresh) - 1
            entries = found.flatten().to_numpy()
            of_entry = np.repeat(group, pc.list_value_length(found).to_numpy())
            n = (entries & ((1 << 48) - 1)).astype(float)
            score = np.stack([np.bincount(of_entry, weights=n * gain[entries >> 48, k], minlength=group[-1] + 1) for k in range(classes)], 1)
            firsts = words.take(pa.array(np.nonzero(fresh)[0]))
            if last is not None:
                if firsts[0].as_py() == last:
                    score[0] += open_score
                else:
                    yield best(pa.array([last], pa.string()), open_score[None])
            yield best(firsts[:-1], score[:-1])
            last, open_score = firsts[-1].as_py(), score[-1]
        if last is not None:
            yield best(pa.array([last], pa.string()), open_score[None])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, class int")


def _emissions(joined: DataFrame, of_class, n_end: int, total: int, types: int, alpha: float, kind: str) -> DataFrame:
    """Per text: ``doc_id, held_out, n_tokens, n_known, base_score, emission, path`` (the classes of its words, a byte each)."""
    import numpy as np

    n_class, v_class = of_class
    norm = np.log10(n_class + alpha * (v_class + 1))
    base = lambda n: np.log10((n + 1) / (total + types + 1))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [_lists(batch, c) for c in ("doc_ids", "held", "sizes", "places", "counts")]
            for types_here, codes, ids, held, sizes, places, counts in zip(batch.column("n_types").to_pylist(), batch.column("codes").to_pylist(), *columns):
                n, cls = np.zeros(types_here), np.full(types_here, UNKNOWN, np.uint8)
                if places is not None:
                    place = places.to_numpy()
                    n[place >> 8] = counts.to_numpy()
                    cls[place >> 8] = place & 255
                known = cls != UNKNOWN
                emit = np.zeros(len(n))
                emit[known] = np.log10(n[known] + alpha) - norm[cls[known]]
                codes, sizes = np.frombuffer(codes, np.uint32), sizes.to_numpy().astype(np.int64)
                which = np.repeat(np.arange(len(sizes)), sizes)
                add = lambda v: np.bincount(which, weights=v[codes], minlength=len(sizes))  # noqa: E731, B023
                path, ends = cls[codes], np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(sizes + 1), pa.array((add(known) + (n_end > 0)).astype(np.int64)), pa.array(add(base(n)) + base(n_end)),
                     pa.array(add(emit)), pa.array([path[e - s:e].tobytes() for s, e in zip(sizes, ends)], pa.binary())],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "path"])

    return joined.select(F.size("words").alias("n_types"), "doc_ids", "held", "sizes", "codes", "places", "counts").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emission double, path binary")


def _transitions(paths: DataFrame, classes: int) -> DataFrame:
    """``pair, n`` over training texts; the boundary is class ``classes``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        size = classes + 1
        for batch in batches:
            out = np.zeros(size * size, np.int64)
            for path in batch.column(0).to_pylist():
                c = np.frombuffer(b"%c" % classes + path + b"%c" % classes, np.uint8).astype(np.int64)
                out += np.bincount(c[:-1] * size + c[1:], minlength=size * size)
            seen = np.nonzero(out)[0]
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(out[seen])], ["pair", "n"])

    return paths.where("NOT held_out").select("path").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def path_score(path: bytes, steps, unknown, state) -> float:
    """log10 of the transitions along ``path`` and of the unknown words' emissions."""
    import numpy as np

    boundary = len(steps) - 1
    c = np.empty(len(path) + 2, np.int64)
    c[0] = c[-1] = boundary
    c[1:-1] = np.frombuffer(path, np.uint8)
    extra = 0.0
    holes = np.nonzero(c == UNKNOWN)[0]
    for i in holes.tolist():
        extra += unknown[c[i - 1]]
        c[i] = state[c[i - 1]]
    known = np.ones(len(c) - 1, bool)
    known[holes - 1] = False
    return float(steps[c[:-1], c[1:]][known].sum()) + extra


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: int = CLASSES, core: int = CORE,
           alpha: float = EMISSION, beta: float = TRANSITION) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Scores are log10 probabilities of the text and its end: ``base_score`` of
    words one by one with add-one smoothing, ``score`` of the class model.  Empty
    and null texts are an end alone; repeated rows train as often as they come;
    without training texts all words are unknown.
    """
    import numpy as np

    if not 0 < classes < UNKNOWN:
        raise ValueError("a class is a byte")
    blocks = stored(coded(docs, doc_id, text), "blocks")
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "n_train")).alias("code", "w")).select("block", "code", "w.words", "w.n_train")
    counts = stored(words.groupBy(F.col("words").alias("word")).agg(F.sum("n_train").alias("n")).where("n > 0"), "counts")
    n_words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_end = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    total, types = n_words + n_end, types + (n_end > 0)

    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(core).collect()]
    found, class_counts = exchange(_matrix(_pair_counts(blocks, top), len(top) + 2), classes)
    of_core = found.tolist()
    stepped = _steps(_contexts(blocks, top, of_core, classes), class_counts, classes)
    core_table = docs.sparkSession.createDataFrame([*zip(top, of_core)], "word string, core_class int")
    neutral = int(np.argmax(class_counts[:classes].sum(1)))  # for a word that only ever stands between words outside the core
    vocabulary = counts.join(stepped, "word", "left").join(F.broadcast(core_table), "word", "left")
    vocabulary = stored(vocabulary.select("word", "n", F.coalesce("core_class", "class", F.lit(neutral)).alias("class")), "vocabulary")

    n_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    place = F.shiftleft(F.col("code").cast("long"), 8) + F.col("class")
    known = words.join(vocabulary, words["words"] == vocabulary["word"]).select("block", place.alias("place"), "n")
    known = known.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))  # one of each a word of the block
    paths = stored(_emissions(blocks.join(known, "block", "left"), (n_class, v_class), n_end, total, types, alpha, type_of(docs, doc_id)), "paths")

    moves = _matrix(_transitions(paths, classes), classes + 1) + beta
    steps = moves / moves.sum(1, keepdims=True)
    of_unknown = steps[:, :classes] * alpha / (n_class + alpha * (v_class + 1))
    tables = np.log10(steps), np.log10(of_unknown.sum(1)), of_unknown.argmax(1)

    def run(batches):
        import pyarrow as pa

        score = partial(path_score, steps=tables[0], unknown=tables[1], state=tables[2])
        for batch in batches:
            path = np.array([score(p) for p in batch.column("path").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out[:-1]], pa.array(batch.column("emission").to_numpy() + path)], out)

    out = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    scored = paths.mapInArrow(run, f"doc_id {type_of(paths, 'doc_id')}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))
