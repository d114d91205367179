"""Streaming forms of the merge of snapshots, the soft validation and the graduation of datasets.

Each takes a streaming DataFrame (or a folder to watch) and returns one, or a
writer that is not started: the caller chooses sink, trigger and checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from trencher.operators.daily import CLEAN_DAYS
from trencher.operators.merge import merge_sources
from trencher.operators.validate import soft_findings

#: Snapshots older than this, counted from the newest one, are not merged.
MAX_AGE = "7d"


def snapshots(spark: SparkSession, folder: str, schema: StructType | str, max_age: str = MAX_AGE, files_per_batch: int = 100) -> DataFrame:
    """The folder's JSON-lines snapshots as a stream, each row with the ``snapshot`` file it came from."""
    reader = spark.readStream.schema(schema).option("maxFileAge", max_age).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).withColumn("snapshot", F.col("_metadata.file_name"))


def merged(rows: DataFrame, out: str, order: Sequence[str]) -> DataStreamWriter:
    """Writes the merge of each batch of scraped ``rows`` to its own folder ``batch=N`` of ``out``.

    A batch that is run again after a failure replaces its folder, so each is
    there once.
    """
    def write(batch: DataFrame, number: int) -> None:
        merge_sources(batch, order).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(write)


def validated(nutrition: DataFrame, items: DataFrame) -> DataFrame:
    """Findings of the records that arrive, by a stateless stream-table join; every record goes on as it is."""
    return soft_findings(nutrition, items)


DAY = "dataset string, day date, clean_days long, mode string"


def graduation(days: DataFrame, threshold: int = CLEAN_DAYS) -> DataFrame:
    """``dataset, day, clean_days, mode`` after each day that arrives, folded per dataset in order.

    ``days``: ``dataset, day, high, medium, auto_fixes``, one row per dataset and
    day.  A day that is not after the last one folded was seen before and is
    skipped, so files delivered twice do no harm.  The state is one row a dataset.
    """
    def fold(key, batches, state: GroupState):
        import pandas as pd

        clean, mode, last = state.get if state.exists else (0, "daily", None)
        # A dataset's days of one batch, which the calendar bounds.
        rows = pd.concat(list(batches)).sort_values("day").drop_duplicates("day")
        out = []
        for day, high, medium, fixes in rows[["day", "high", "medium", "auto_fixes"]].itertuples(index=False):
            if last is not None and day.toordinal() <= last:
                continue
            found, last = high + medium > 0, day.toordinal()
            clean = 0 if found or fixes else clean + 1
            mode = "daily" if found else "weekly" if clean >= threshold else mode
            out.append((key[0], day, clean, mode))
        if last is not None:
            state.update((clean, mode, last))
        yield pd.DataFrame(out, columns=["dataset", "day", "clean_days", "mode"])

    rows = days.select(F.col("dataset").cast("string"), F.col("day").cast("date"), "high", "medium", "auto_fixes")
    return rows.groupBy("dataset").applyInPandasWithState(fold, DAY, "clean long, mode string, last long", "append", GroupStateTimeout.NoTimeout)
