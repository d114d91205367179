"""Conditions that test one place of a text, and the edges of words."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trencher.functions.rules import RuleTable
from trencher.functions.text import edges
from trencher.functions.vocab import foods
from trencher.functions.vocab import impute as V
from trencher.plans import load_queries, looks
from trencher.plans.catalogue import quoted
from trencher.plans.registry import QUERIES


def first(spark, rules, columns, text, category="entree"):
    table = RuleTable(rules, columns)
    row = spark.createDataFrame([(text, category)], "t string, c string").select(table.output(table.first(F.col("t"), category=F.col("c")), columns[0]).alias("o")).first()
    return row["o"]


@pytest.mark.parametrize("text, share", [("ham and hamburger slider", 2.2), ("hamburger", 1.0), ("cheese and cheesecake", 1.5), ("cheesecake", 0.75), ("mac and cheesecake", 1.5)])
def test_sodium(spark, text, share):
    assert first(spark, V.SODIUM, ("share",), text) == share


@pytest.mark.parametrize("text, share", [("ham and hamburger slider", 0.30), ("hamburger", 0.22)])
def test_protein(spark, text, share):
    assert first(spark, V.PROTEIN, ("share",), text) == share


@pytest.mark.parametrize("text, template", [("coke zero or coke", "regular_soda"), ("coke  zero", None), ("cola or coke zero", "regular_soda"), ("apple juice and an apple", "apple_juice"), ("apple", "apple")])
def test_templates(spark, text, template):
    assert first(spark, V.TEMPLATES, V.TEMPLATE_COLUMNS, text) == template


@pytest.mark.parametrize("text, label", [
    ("impossible burger", "burger"), ("burger impossible", None), ("cheeseburger impossible", "burger"),
    ("pretzel kitchen", "pretzel"), ("pretzel of pretzel kitchen", "pretzel"), ("beer cheese", None), ("cheese and beer", "beer"),
    ("shrimp cocktail", None), ("shrimp cocktail and a cocktail", "cocktail"), ("cheesesteak", None), ("steak and cheesesteak", "steak"),
    ("fish finger", None), ("finger of fish", "fish entree"), ("wine cake", None), ("cake with wine", "wine"),
])
def test_profiles(spark, text, label):
    assert first(spark, foods.PROFILES, foods.PROFILE_COLUMNS, text) == label


TEXTS = ("ham", "hamburger", "hamburger ham", "hamhamburger", "cheese cheesecake", "cheesecake", "coke zero coke", "coke zero", "sprite coke zero", "apple juice", "apple", "apple apple juice",
         "impossible burger", "burger impossible burger", "burger impossible", "hamburger impossible", "pretzel pretzel kitchen", "pretzel kitchen pretzel", "beer butter", "butter beer",
         "beer butter beer", "wine bar", "bar wine", "fruit cocktail", "cocktail", "sangria fruit cocktail", "steak fries", "steakhouse steak", "filet de saumon", "ribeye steak dog", "fish finger",
         "salmon fish finger", "finger fish", "")


@pytest.mark.parametrize("pattern", sorted(looks.LOOKS))
def test_other_position_tests_agree(spark, pattern):
    mine = {r["t"]: r["hit"] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", F.col("t").rlike(edges(pattern)).alias("hit")).collect()}
    rows = ", ".join(f"({quoted(t)}, {looks.parts(pattern)})" for t in TEXTS)
    theirs = dict(duckdb.sql(f"SELECT t, {looks.test('t')} FROM (VALUES {rows}) r(t, inc, bare, blank, cut)").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("text, hit", [("ale", True), ("pale", False), ("an ale!", True), ("aleé", True), ("éale", True), ("ale_", False)])
def test_edges_are_those_of_ascii_words(spark, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(edges(r"\bale\b")).alias("hit")).first()["hit"] is hit


@pytest.mark.parametrize("name", ["profile_findings", "template_estimates", "dietary_annotations", "math_findings", "alcohol_detectors", "browse_view", "park_attributes", "portion_adjustments", "soft_validations"])
def test_no_bare_word_edge_reaches_the_jvm(spark, name):
    load_queries()
    assert r"\b" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
