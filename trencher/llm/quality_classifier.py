"""A hierarchical empirical-Bayes quality classifier.

A document's evidence is the log likelihood ratio that a logistic regression
finds in its words and style, one for low quality and one for toxicity.  Its
prior comes from its site: the share of bad documents in its path, shrunk towards
its host's, shrunk towards the share of all documents, each by a weight fitted to
how much paths and hosts differ beyond chance.  Sites are counted over all
documents, by label where there is one and else by the classifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, text_or_empty

#: Labelled rows that the classifiers are fitted on, at most: those of least hash, each text once.
SAMPLE = 20_000
#: Features count from this difference between good and bad on; the sample bounds how many there are.
MIN_Z = 4.0
STEMS = (4, 5)
RIDGE, ROUNDS, RATE = 1e-4, 200, 0.1
BAD = ("low_quality", "toxic")
WEAKEST, STRONGEST = 1.0, 1e6
KINDS = {"capitals": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "symbols": b"#*$%&|<>"}
PUNCTUATION = ".,;:!?\"'()[]"


def style(text: str) -> set[str]:
    """How frequent each kind of odd character is in a word, in tenths."""
    raw = text.encode("utf-8", "surrogatepass")
    n = raw.count(b" ") + raw.count(b"\n") + 1
    kinds = {name: len(raw) - len(raw.translate(None, chars)) for name, chars in KINDS.items()} | {"shouts": raw.count(b"!!")}
    lines = text.split("\n")
    words = text.split()
    varied = 10 * len(set(words)) // max(1, len(words))
    return {f"%varied:{varied}"} | {f"%{k}:{min(30, 10 * v // n)}" for k, v in kinds.items()} | {f"%repeats:{10 * (len(lines) - len(set(lines))) // len(lines)}", f"%length:{min(6, n.bit_length())}"}


def of_word(word: str) -> tuple[str, ...]:
    """The features of a lower-cased word: itself without punctuation, and its first letters."""
    bare = word.strip(PUNCTUATION)
    return (bare, *(f"^{bare[:n]}" for n in STEMS if len(bare) > n))


class _Words(dict):
    """Those of each word's features that are wanted, remembered up to a limit."""

    def __init__(self, wanted):
        self.wanted = wanted

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        self[word] = found = tuple(f for f in of_word(word) if self.wanted is None or f in self.wanted)
        return found


def features(text: str, words: _Words) -> set[str]:
    found = style(text)
    for fs in map(words.__getitem__, set(text.lower().split())):
        if fs:
            found.update(fs)
    return found


def _chosen(sample: DataFrame) -> list[list[str]]:
    """The features of each classifier: those of the sample that differ enough come to the driver."""
    columns = [f"{b}_{i}" for b in BAD for i in (0, 1)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words, codes, found, kinds = _Words(None), {}, [], []

        def passed_on():
            n, at = len(codes), np.concatenate(found)
            of = np.repeat(np.concatenate(kinds), [len(f) for f in found], axis=0)
            counts = [np.bincount(at[of[:, k] == i], minlength=n) for k in range(len(BAD)) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(list(codes), pa.string()), *map(pa.array, counts)], ["feature", *columns])

        for batch in batches:
            for text, *bad in zip(*(batch.column(c).to_pylist() for c in ("text", *BAD))):
                found.append(np.array([codes.setdefault(f, len(codes)) for f in features(text, words)], np.int64))
                kinds.append(np.array([[-1 if b is None else b for b in bad]]))
                if len(codes) > 500_000:
                    yield passed_on()
                    codes, found, kinds = {}, [], []
        if found:
            yield passed_on()

    counted = sample.mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in columns)).groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns])
    counted = stored(counted, "features")
    totals = sample.agg(*[F.count_if(F.col(b) == i).alias(f"{b}_{i}") for b in BAD for i in (0, 1)]).first()
    out = []
    for b in BAD:
        bad, good = totals[f"{b}_1"], totals[f"{b}_0"]
        if not bad or not good:
            out.append([])
            continue
        p, q = (F.col(f"{b}_1") + 0.5) / (bad + 1), (F.col(f"{b}_0") + 0.5) / (good + 1)
        pooled = (F.col(f"{b}_1") + F.col(f"{b}_0") + 1) / (bad + good + 2)
        z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good))
        out.append([r["feature"] for r in counted.select("feature", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy("feature").collect()])
    return out


def regression(of, at, bad, n_features: int):
    """Weights and intercept of a ridge logistic regression on sets of features: row ``of[i]`` has feature ``at[i]``."""
    import numpy as np

    n, k = len(bad), n_features
    each = np.empty(len(at))
    w, first, second = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, ROUNDS + 1):
        error = (1 / (1 + np.exp(-(np.bincount(of, weights=np.take(w, at, out=each, mode="clip"), minlength=n) + w[k]))) - bad) / n
        slope = np.append(np.bincount(at, weights=np.take(error, of, out=each, mode="clip"), minlength=k) + RIDGE * w[:k], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w -= RATE * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
    return w[:k], w[k]


def _fitted(sample: DataFrame) -> tuple[dict[str, tuple[float, ...]], list[float]]:
    """Weights of each feature, and what each classifier adds so that the sum is a log likelihood ratio."""
    import numpy as np
    import pyarrow.compute as pc

    chosen = _chosen(sample)
    code = {f: i for i, f in enumerate(dict.fromkeys(f for fs in chosen for f in fs))}
    if not code:
        return {}, [0.0] * len(BAD)

    def run(batches):
        import pyarrow as pa

        words = _Words(code.keys())
        for batch in batches:
            found = [sorted(code[f] for f in features(t, words) & code.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(b) for b in BAD], pa.array(found, pa.list_(pa.int32()))], [*BAD, "found"])

    rows = sample.mapInArrow(run, ", ".join(f"{b} int" for b in BAD) + ", found array<int>").toArrow()  # `SAMPLE` rows at most
    # Kept as arrays: lists of numbers would take many times the memory of the driver.
    sizes = pc.list_value_length(rows.column("found")).to_numpy()
    codes = pc.list_flatten(rows.column("found")).to_numpy()
    weights, added = np.zeros((len(code), len(BAD))), []
    for k, b in enumerate(BAD):
        if not chosen[k]:
            added.append(0.0)
            continue
        own = np.array([code[f] for f in chosen[k]])
        place = np.full(len(code), -1)
        place[own] = np.arange(len(own))
        known = rows.column(b).is_valid().to_numpy()
        wanted = np.repeat(known, sizes) & (place[codes] >= 0)
        bad = rows.column(b).drop_null().to_numpy().astype(float)
        w, intercept = regression(np.repeat(np.cumsum(known) - 1, sizes)[wanted], place[codes[wanted]], bad, len(own))
        weights[own, k] = w
        added.append(float(intercept - np.log(bad.mean() / (1 - bad.mean()))))
    return {f: tuple(weights[i].tolist()) for f, i in code.items()}, added


def _bounded(fitting: DataFrame, sample: int) -> DataFrame:
    """``text`` and labels of at most ``sample`` texts, those of least hash: an id may have many rows, and a text many ids."""
    each = fitting.groupBy("text").agg(*[F.max(b).alias(b) for b in BAD]).withColumn("hash", F.xxhash64("text"))
    each = stored(each, "labelled_texts")
    least = each.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    return each if least is None else each.where(F.col("hash") <= least)


def _evidence(docs: DataFrame, weights: dict[str, tuple[float, ...]], added: list[float]) -> DataFrame:
    """``docs`` without their ``text_``, with the log likelihood ratio of each classifier."""
    names = [c for c in docs.columns if c != "text_"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = _Words(weights.keys())
        for batch in batches:
            sums = np.tile(np.array(added), (batch.num_rows, 1))
            for i, t in enumerate(batch.column("text_").to_pylist()):
                for f in features(t, words) & weights.keys():
                    sums[i] += weights[f]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(sums[:, k]) for k in range(len(BAD))]], [*names, *[f"{b}_llr" for b in BAD]])

    return docs.mapInArrow(run, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{b}_llr double" for b in BAD]))


def _weight(groups: DataFrame, n: str, bad: str, centre) -> float:
    """The weight, in documents, of the beta prior around ``centre`` that explains how much ``bad / n`` differs between groups."""
    share, n_ = F.col(bad) / F.col(n), F.col(n)
    row = groups.agg(F.sum(n_).alias("n"), F.sum(n_ * F.pow(share - centre, 2)).alias("spread"), F.sum(centre * (1 - centre)).alias("chance"),
                     F.sum(n_ * centre * (1 - centre)).alias("within")).first()
    if not row["n"] or row["spread"] <= row["chance"]:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, (row["within"] - (row["spread"] - row["chance"])) / (row["spread"] - row["chance"])))


def _shrunk(bad: str, n: str, centre, weight: float):
    return (F.col(bad) + weight * centre) / (F.col(n) + weight)


def _logistic(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           path: str = "lang", sample: int = SAMPLE, limits: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """The columns ``keep`` (the id, by default) of each row with ``low_quality, toxic`` (posterior probabilities) and ``kept``: both below their limits.

    ``labels``: ``doc_id, quality, toxic`` (0/1, null: unknown); of repeated labels
    of an id the worst counts, and of repeated texts of the sample, too.  A null
    text is empty; null hosts are one host and
    null paths one path of their host; rows of null id have no label.  Without
    labels of both kinds a classifier finds nothing.
    """
    keep = [doc_id] if keep is None else keep
    given = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    given = stored(given.select(F.col("doc_id").alias("label_id"), *BAD), "labels")
    chosen = given.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)  # `sample` rows at most
    fitting = docs.select(F.col(f"`{doc_id}`").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    weights, added = _fitted(_bounded(fitting, sample))
    kept = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    site = [F.col(f"`{host}`").cast("string").alias("host_"), F.col(f"`{path}`").cast("string").alias("path_")]
    rows = docs.select(*kept, F.col(f"`{doc_id}`").alias("id"), *site, text_or_empty(text).alias("text_"))
    evidence = stored(_evidence(rows, weights, added), "evidence")
    known = evidence.join(given, F.col("id") == F.col("label_id"), "left")
    share = known.agg(*[F.avg(b).alias(b) for b in BAD]).first()
    soft = {b: F.coalesce(F.col(b).cast("double"), _logistic(F.col(f"{b}_llr") + _logit(F.lit(share[b] or 0.0)))) for b in BAD}
    paths = stored(known.groupBy("host_", "path_").agg(F.count("*").alias("n"), *[F.sum(soft[b]).alias(b) for b in BAD]), "paths")
    hosts = paths.groupBy(F.col("host_").alias("of_host")).agg(F.sum("n").alias("host_n"), *[F.sum(b).alias(f"host_{b}") for b in BAD])
    hosts = stored(hosts, "hosts")
    total = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_{b}").alias(b) for b in BAD]).first()
    for b in BAD:
        mean = F.lit((total[b] or 0.0) / (total["n"] or 1))
        hosts = hosts.withColumn(f"{b}_host", _shrunk(f"host_{b}", "host_n", mean, _weight(hosts, "host_n", f"host_{b}", mean)))
    paths = stored(paths.join(stored(hosts, "host_rates"), F.col("host_").eqNullSafe(F.col("of_host"))), "paths_of_hosts")
    priors = [_logit(_shrunk(b, "n", F.col(f"{b}_host"), _weight(paths, "n", b, F.col(f"{b}_host")))).alias(f"{b}_prior") for b in BAD]
    priors = stored(paths.select("of_host", F.col("path_").alias("of_path"), *priors), "priors")
    out = evidence.join(priors, F.col("host_").eqNullSafe(F.col("of_host")) & F.col("path_").eqNullSafe(F.col("of_path")), "left")
    out = out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[_logistic(F.col(f"{b}_llr") + F.col(f"{b}_prior")).alias(b) for b in BAD])
    return out.withColumn("kept", (F.col(BAD[0]) < limits[0]) & (F.col(BAD[1]) < limits[1]))
