"""Line dedup by site-relative frequency.

A line's frequency is the share of its host's pages that contain it.  Lines
above ``ratio`` are boilerplate of that host and are dropped there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, whole_row

SPACE = " \t\n\x0b\x0c\r"
RATIO = 0.1
MIN_PAGES = 5


def _bare(line):
    return F.btrim(line, F.lit(SPACE))


def _lines(text: str):
    return F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n")


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: digests of each host's lines on more than ``ratio`` of its pages, and on ``min_pages`` at least.

    A page counts a line once; white space around it does not count, and lines
    without a word are no lines.  Every line of the list stands on over ``ratio``
    of the pages, so a host's list has at most ``1 / ratio`` times the mean number
    of lines of its pages.
    """
    own = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _bare(x) != ""), lambda x: F.unhex(F.md5(_bare(x)))))
    name = F.col(f"`{host}`").cast("string").alias("host")
    counts = docs.select(name, F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = stored(docs.groupBy(name).agg(F.count("*").alias("pages")), "pages").withColumnRenamed("host", "of")
    frequent = counts.join(pages, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_set("line").alias("lines"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
                        least_kept: float = 0.0) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and ``lines_dropped``.

    ``least_kept``: a page that would keep less than this share of its characters
    stays whole.  Most of its lines stand on many pages, so it is a copied text
    rather than a page with boilerplate.  A null text stays null; else a text of
    boilerplate only becomes empty; pages of null host are one host; repeated rows
    are pages of their own.  A column ``lines_dropped`` of the given table is
    replaced.
    """
    name, whole = F.col(f"`{host}`").cast("string"), F.col(f"`{text}`").cast("string")
    found = stored(boilerplate(docs, host, text, ratio, min_pages), "boilerplate").select(F.col("host").alias("of"), F.col("lines").alias("frequent"))
    df = docs.select(whole_row(docs.columns).alias("row"), name.alias("host"), whole.alias("text"))
    df = df.join(found, F.col("host").eqNullSafe(F.col("of")), "left")
    left = F.filter(_lines("text"), lambda x: ~F.array_contains(F.col("frequent"), F.unhex(F.md5(_bare(x)))))
    df = df.withColumn("left", F.when(F.col("frequent").isNotNull() & F.col("text").isNotNull(), left))
    if least_kept:
        df = df.withColumn("left", F.when(F.length(F.array_join("left", "\n")) >= least_kept * F.length("text"), F.col("left")))
    changed, own = F.col("left").isNotNull(), F.col(f"row.`{text}`")
    dropped = F.when(changed, F.size(_lines("text")) - F.size("left")).otherwise(0).cast("long").alias("lines_dropped")
    return df.select(*[F.when(changed, F.array_join("left", "\n")).otherwise(own).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "lines_dropped"], dropped)
