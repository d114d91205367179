"""Streams against their batch forms; file sources and memory or file sinks only."""

from collections import Counter

from pyspark.sql import functions as F

from trencher.operators import daily, merge, validate
from trencher.plans.catalogue import Catalogue
from trencher.streaming import audits

FOLDER = "/root/testdata/sf0.001"


def run(writer, at):
    query = writer.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    query.stop()


def test_graduation_equals_the_batch_form(spark, tmp_path):
    lines = Catalogue(spark, FOLDER).table("lineitem")
    days = lines.groupBy(F.col("l_suppkey").cast("string").alias("dataset"), F.to_date("l_shipdate").alias("day")).agg(
        F.count_if(F.expr("round(l_discount * 100) = 10")).alias("high"), F.count_if(F.expr("l_quantity < 2")).alias("medium"), F.count_if(F.expr("l_tax > 0.07")).alias("auto_fixes"))
    days = days.where("dataset < '4'")
    want = Counter(map(tuple, daily.graduation(days).select("dataset", "day", "clean_days", "mode").collect()))
    cut = "DATE'1995-06-01'"
    for part in (days.where(f"day < {cut}"), days.where(f"day >= {cut}"), days.where(f"day < {cut}")):  # the first part comes twice
        part.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(days.schema).parquet(f"{tmp_path}/in")
        run(audits.graduation(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append"), tmp_path)
    assert Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("dataset", "day", "clean_days", "mode").collect())) == want


def test_soft_validation_equals_the_batch_form(spark, tmp_path):
    cat = Catalogue(spark, FOLDER)
    nutrition = cat.nutrition.select("nutrition_id", "item_id", "calories", "carbs", "fat", "protein")
    nutrition.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(nutrition.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(audits.validated(stream, cat.items).writeStream.format("parquet").option("path", f"{tmp_path}/out"), tmp_path)
    want = Counter(map(tuple, validate.soft_findings(nutrition, cat.items).collect()))
    got = Counter(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == want and {k[2] for k in got} == {"atwater_deviation", "extreme_calories"}


def test_snapshots_merge_batch_by_batch(spark, tmp_path):
    kind = "source string, park_name string, restaurant_name string, land string, name string, description string, price double, category string, nth long"
    rows = [("yelp", "Park", "Grill", None, "Taco", "old", 3.0, None, 1), ("official", "Park", "Grill", "East", "taco!", "new", 4.0, "entree", 2)]
    for n in range(2):
        spark.createDataFrame(rows[: n + 1], kind).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        run(audits.merged(audits.snapshots(spark, f"{tmp_path}/in", kind), f"{tmp_path}/out", ["nth"]), tmp_path)
    out = spark.read.parquet(f"{tmp_path}/out").select("batch", "name", "price", "confidence").orderBy("batch").collect()
    assert [tuple(r) for r in out] == [(0, "Taco", 3.0, 40), (1, "taco!", 4.0, 100)]
    want = merge.merge_sources(spark.createDataFrame(rows, kind), ["nth"]).select("name", "price", "confidence").collect()
    assert [tuple(r) for r in want] == [tuple(out[1])[1:]]
