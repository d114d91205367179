"""Extra columns named like an operator's own: they stay as they are, or an output of that name replaces them."""

import pytest
from pyspark.sql import functions as F

from trencher.llm import alignment, decontaminate, line_dedup, near_copies, packing, permutation_index, quality_classifier, quality_rules, sharding, simhash

NAMES = ["row", "host", "host_", "of", "of_host", "left", "kept_", "lines_", "lines_dropped", "text_", "n_words", "kept", "words_", "length_", "part", "part_", "rank_in_part", "n", "n_", "first", "rank",
         "sequence_id", "shard", "path_", "cell_", "hash_", "bytes_", "row_", "depth", "depth_", "fingerprint", "key", "component_id", "md5", "size", "id", "label_id", "id_", "class", "vector"]


@pytest.fixture(scope="module")
def given(spark):
    rows = [(i, f"same line\nown {i} " + "word " * 60, "en", "s") for i in range(12)] + [(20, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES])


def same(found, outputs):
    for r in found.collect():
        for n in NAMES:
            if n not in outputs:
                assert r[n] == f"{n}{r['doc_id']}"
    assert sorted(found.columns) == sorted(set(found.columns))


def test_line_dedup(given):
    found = line_dedup.without_boilerplate(given)
    same(found, ["lines_dropped"])
    assert {r["lines_dropped"] for r in found.collect()} == {0, 1} and found.columns.count("lines_dropped") == 1


def test_quality_rules(given):
    found = quality_rules.judged(given)
    same(found, quality_rules.OUTPUTS)
    assert {r["n_words"] for r in found.collect()} == {64, 0}


def test_packing(given):
    found = packing.pack(given.withColumn("length", F.lit(700)))
    same(found, packing.PLACES)
    assert found.agg(F.count_distinct("sequence_id", "offset")).first()[0] == 13


def test_sharding(given):
    found = sharding.sharded(given, limit=400)
    same(found, sharding.OUTPUTS)
    assert found.count() == 13 and found.select("shard").distinct().count() > 1


def test_simhash(given):
    assert simhash.near_duplicates(given).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(given.select(F.col("doc_id").alias("fingerprint"), "text"), "fingerprint").columns == ["key", "fingerprint", "component_id"]


def test_operators_that_read_named_columns_only(given, spark):
    assert alignment.alignment(given).count() == near_copies.links(given, "doc_id").count() + 13
    benchmark = spark.createDataFrame([(1, "word " * 13)], "item_id long, text string")
    assert decontaminate.contamination(given, benchmark).where("contaminated").count() == 12
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.judged(given, labels).count() == 13
    vectors = given.select("doc_id", F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"), *[n for n in NAMES])
    assert permutation_index.search(vectors, "doc_id", every=20).count() == 20
