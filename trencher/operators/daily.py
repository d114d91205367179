"""Daily audit state: clean-day streaks, the audit's mode and its recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Clean days in a row until audits go weekly, and entries that a history keeps.
CLEAN_DAYS, HISTORY = 14, 30


def graduation(days: DataFrame, dataset: str = "dataset", day: str = "day", threshold: int = CLEAN_DAYS) -> DataFrame:
    """Adds ``clean_days`` (days in a row without a high or medium finding or an automatic fix) and ``mode``.

    ``days`` has one row per dataset and day, with counts ``high, medium,
    auto_fixes``.  The mode turns ``weekly`` when the streak reaches ``threshold``
    and ``daily`` on a high or medium finding; a day of fixes only ends the streak.
    A dataset's days are ordered in one task, which the calendar bounds.
    """
    w = Window.partitionBy(dataset).orderBy(day)
    found = (F.col("high") > 0) | (F.col("medium") > 0)
    clean = ~found & (F.col("auto_fixes") == 0)
    df = days.withColumn("_run", F.count_if(~clean).over(w)).withColumn("_segment", F.count_if(found).over(w))
    run = Window.partitionBy(dataset, "_run").orderBy(day)
    df = df.withColumn("clean_days", F.count_if(clean).over(run))
    segment = Window.partitionBy(dataset, "_segment").orderBy(day)
    weekly = F.max("clean_days").over(segment) >= threshold
    return df.withColumn("mode", F.when(weekly, "weekly").otherwise("daily")).drop("_run", "_segment")


def recent(days: DataFrame, dataset: str = "dataset", day: str = "day", size: int = HISTORY) -> DataFrame:
    """The last ``size`` days of each dataset."""
    w = Window.partitionBy(dataset).orderBy(F.desc(day))
    return days.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= size).drop("_nth")
