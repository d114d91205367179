"""The near-duplicate stage against brute force, with copies planted at 0.8 to 0.95."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from trencher.llm import components, near_copies, shared, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(texts):
    words = [(t or "").lower().encode().split() for t in texts]
    return [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in words]


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Texts of 60 to 400 words, each with copies edited ever more, a passage that all share, short texts and a long chain."""
    rng = np.random.default_rng(5)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage, texts = prose(40), []
    for n in (60, 120, 250, 400) * 6:
        own = prose(n) + passage
        texts.append(" ".join(own))
        for edits in range(1, 1 + n // 30):
            copy = list(own)
            for at in rng.choice(len(copy), edits, replace=False):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    base = prose(150)
    for i in range(100):  # near copies of one text, in one large group
        copy = list(base)
        copy[i] = f"own{i}"
        texts.append(" ".join(copy))
    return [*texts, None, "", " \n", "a b", "A  b", "a b c", "a b c d e f", "a b c d e f g", "x " * 50, "x " * 60]


def test_copies_of_four_fifths_go(spark):
    texts = planted()
    own = sets(texts)
    found = {(i, j): s for i in range(len(own)) for j in range(i) if (s := similarity(own[i], own[j])) >= 0.8}
    assert sum(0.8 <= s < 0.85 for s in found.values()) > 10 and sum(0.85 <= s < 0.95 for s in found.values()) > 10
    group = list(range(len(own)))
    for i, j in found:
        if group[i] != group[j]:
            old = group[i]
            group = [group[j] if g == old else g for g in group]
    least = {}
    for i, g in enumerate(group):
        least[g] = min(i, least.get(g, i))
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, given, "").collect()}
    assert kept == set(least.values())
    of = dict(components.roots(near_copies.links(given, "doc_id")).collect())
    assert all(of[i] == of[j] for i, j in found)  # recall 1
    assert near_copies.links(given.limit(0), "doc_id").count() == 0


def test_common_shingles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "COMMON_ABOVE", 1)
    texts = planted()[:80]
    own = sets(texts)
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    of = dict(components.roots(near_copies.links(given, "doc_id")).collect())
    for i in range(len(own)):
        for j in range(i):
            assert similarity(own[i], own[j]) < 0.8 or of[i] == of[j]


def test_sketches_never_exclude_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 700, 9000):
        base = rng.integers(-1 << 62, 1 << 62, n)
        for share in (0.0, 0.5, 0.9):
            other = np.concatenate([base[:int(n * share)], rng.integers(-1 << 62, 1 << 62, 1 + n // 7)])
            x, y = np.unique(base), np.unique(other)
            bound = near_copies._most_shared(near_copies._sketch(x), near_copies._sketch(y))
            assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_extra_columns_and_many_equal_texts(spark):
    rows = [(i, "one two three four five six" if i % 2 else f"text {i} of its own kind", i, "s") for i in range(60)]
    given = spark.createDataFrame(rows, "doc_id long, text string, row long, md5 string")
    of = {r["node"]: r["root"] for r in near_copies.groups(given, "doc_id").collect()}
    assert of == {i: 1 for i in range(1, 60, 2)}


def test_the_stage_searches_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    given = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "of its own"), (4, None), (5, " ".join(words))]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    pairs = {(r["a"], r["b"]) for r in simhash.close_pairs(docs.where("doc_id IN (1, 2, 3)")).collect()}
    assert pairs == {(1, 2)}
    named = []
    plain = simhash.close_pairs
    monkeypatch.setattr(simhash, "close_pairs", lambda *a, **k: named.append(plain(*a, **k)) or named[-1])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {1, 3, 4} and named[0].count() == 1


def test_links_that_fingerprints_do_not_name_are_found(spark, monkeypatch):
    texts = planted()[::3]
    own = sets(texts)
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    group = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if group[i] != group[j] and similarity(own[i], own[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    # One fingerprint for all names only pairs with the first text, which is no near copy of the others'.
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, *_: docs.select(F.col(key).alias("key"), F.lit(5).cast("long").alias("fingerprint")))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, given, "").collect()}
    assert kept == {group.index(g) for g in group} and 1 < len(kept) < len(texts)


def test_exploded_and_wide_rows_are_not_broadcast(spark, tmp_path, capsys):
    values = np.random.default_rng(3).integers(-1 << 62, 1 << 62, 2000).tolist()
    spark.createDataFrame([(v,) for v in values], "fingerprint long").write.parquet(f"{tmp_path}/classes")
    spark.createDataFrame([(i, 1000, bytes(4096)) for i in range(500)], "row long, size int, sketch binary").write.parquet(f"{tmp_path}/sketches")
    spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long").write.parquet(f"{tmp_path}/pairs")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    capsys.readouterr()
    simhash.links(read("classes")).explain()
    plan = capsys.readouterr().out
    met = [line for line in plan.splitlines() if "Join [half" in line and "fine" in line]
    assert met and all("SortMergeJoin" in line for line in met)
    near_copies._not_excluded(read("pairs"), read("sketches")).explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_texts_and_sketches_are_not_shuffled_whole(spark, monkeypatch, capsys):
    plans, plain = {}, shared.stored

    def written(df, name):
        capsys.readouterr()
        df.explain("formatted")
        moved = [p for p in capsys.readouterr().out.split("\n\n") if ") Exchange\n" in p]
        plans.setdefault(name, []).extend(moved)
        return plain(df, name)

    monkeypatch.setattr(near_copies, "stored", written)
    monkeypatch.setattr(simhash, "stored", written)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [*planted()[:12], *planted()[:4]]
        given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
        kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, given, "").collect()}
        assert len(kept) < 12 and max(kept) < 12
        assert plans["fingerprints"] and plans["shared"]
        assert not [name for name, moved in plans.items() if name != "sets" and any(" text#" in p or "[text#" in p for p in moved)]
        assert not [name for name, moved in plans.items() if name != "pairs" and any("sketch#" in p for p in moved)]
        many = spark.range(20_000).select(F.col("id").alias("row"), F.concat(F.lit("text "), "id").alias("text"))
        nodes = spark.createDataFrame([(i,) for i in (3, 77, 19_999)], "row long")
        among = near_copies._among(many, nodes)
        assert {tuple(r) for r in among.collect()} == {(i, f"text {i}") for i in (3, 77, 19_999)}
        assert near_copies._among(many, nodes.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_with_and_without_copies_meet_the_same(spark, monkeypatch):
    texts = [*planted()[:14], *planted()[:7], *planted()[:3]]
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    few = {tuple(r) for r in near_copies.groups(given, "doc_id").collect()}
    # A bitmap without empty bits: every text is taken for one that may have copies.
    plain = near_copies._shingled
    monkeypatch.setattr(near_copies, "_shingled", lambda t, common, repeated: plain(t, common, b"\xff" * len(repeated)))
    assert {tuple(r) for r in near_copies.groups(given, "doc_id").collect()} == few
    assert {node for node, _ in few} >= set(range(14, 24))
