"""Quality rules with verdicts on hosts, in DataFrame functions only.

Each document is held against fixed rules.  Failures are counted by host and
rule; a host's rate is shrunk towards the rate of all hosts with a beta prior
whose strength is fitted to how much hosts differ beyond chance.  A host whose
shrunk rate of any rule is above ``max_rate`` is rejected with all its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import given, stored, whole_row

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_RATE = 0.5
#: The weight of the prior, in documents, is kept within these.
WEAKEST, STRONGEST = 1.0, 1e6

#: A document fails a rule where its condition holds.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repetitive")


OUTPUTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]


def features(rows: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` to ``row`` and ``host`` of ``rows(row, host, text_)``.

    A text without words has zeros.  Windows of three words are compared by 64-bit
    hashes within one text.
    """
    keep = ["row", "host"]
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0
    df = rows
    bare = F.btrim("text_", F.lit(SPACE))
    df = df.select(*[F.col(f"`{c}`") for c in keep], "text_",
                   F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES)).alias("words_"),
                   F.filter(F.split("text_", "\n"), has_word).alias("lines_"))
    words, n = F.col("words_"), F.size("words_")
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    df = df.withColumn("windows_", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)))
    placed = F.array_sort(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    df = df.withColumn("placed_", F.when(F.size(F.array_distinct("windows_")) < F.size("windows_"), placed))
    seen = F.col("placed_")
    twin = lambda g, i: F.coalesce(g["h"] == F.get(seen, i - 1)["h"], F.lit(False)) | F.coalesce(g["h"] == F.get(seen, i + 1)["h"], F.lit(False))
    repeated = F.array_sort(F.transform(F.filter(seen, twin), lambda g: g["at"]))
    covered = F.aggregate(repeated, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
                          lambda a, at: F.struct((at + 3).alias("to"), (a["n"] + at + 3 - F.greatest(a["to"], at)).alias("n")), lambda a: a["n"])
    return df.select(
        *[F.col(f"`{c}`") for c in keep], n.cast("long").alias("n_words"),
        F.length(F.translate("text_", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text_") - F.length(F.translate("text_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines_").cast("long").alias("n_lines"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(failures, passes) of the beta prior of each rule, by moments over hosts."""
    pages = F.sum("pages")
    totals = hosts.agg(pages.alias("pages"), F.count("*").alias("hosts"), *[F.sum(r).alias(r) for r in RULES]).first()
    if not totals["pages"]:
        return {r: (0.5, 0.5) for r in RULES}
    mean = {r: totals[r] / totals["pages"] for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("pages") * F.pow(F.col(r) / F.col("pages") - mean[r], 2)) / pages).alias(r) for r in RULES]).first()
    out = {}
    for r, m in mean.items():
        chance = m * (1 - m) * totals["hosts"] / totals["pages"]
        beyond = spread[r] - chance
        weight = STRONGEST if beyond <= 0 else min(STRONGEST, max(WEAKEST, m * (1 - m) / beyond - 1))
        out[r] = (m * weight, (1 - m) * weight)
    return out


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """The columns ``keep`` and the features of each document, with ``base_failed``, ``host_rate`` (the largest shrunk rate) and ``kept``.

    A null text has no words.  Documents of null host are one host.  Repeated
    rows count as often as they come; an empty table gives an empty table.
    Columns of the given table with the name of one of ``OUTPUTS`` are replaced.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    named = docs.select(whole_row(keep).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text_"))
    rows = stored(features(named), "features")
    failed = {r: F.expr(condition) for r, condition in RULES.items()}
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("pages"), *[F.count_if(c).alias(r) for r, c in failed.items()]), "hosts")
    prior = _priors(hosts)
    rates = [(F.col(r) + a) / (F.col("pages") + a + b) for r, (a, b) in prior.items()]
    verdicts = stored(hosts.select(F.col("host").alias("of_host"), F.greatest(*rates).alias("host_rate")), "verdicts")
    base = reduce(lambda x, y: x | y, (failed[r] for r in BASE))
    out = rows.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left").withColumn("base_failed", base)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_rate))
    return out.select(*given(keep, OUTPUTS), *OUTPUTS)
