"""Tables in the folder that the driver and all executors share.

Lineage is cut by writing a table there and reading it again: a lost executor
then costs the re-run of its tasks only, and a table that was numbered once
keeps its numbers.  The size of a table read back is known to the planner, so a
join with it is broadcast only below ``spark.sql.autoBroadcastJoinThreshold``
and shuffled beyond it.  That size is the compressed file's, and exploding adds
nothing to it: joins of tables that grow much in memory ask for a merge.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in this process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="trencher-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/trencher/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def whole_row(columns: list[str]):
    """The given row as one column, so that its names cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("string").alias("none"))


def given(columns: list[str], outputs: list[str], row: str = "row"):
    """The columns of a ``whole_row`` again, but for those that an output replaces."""
    return [F.col(f"`{row}`.`{c}`").alias(c) for c in columns if c not in outputs]
