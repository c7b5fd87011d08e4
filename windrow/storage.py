"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or where it has none the one that spark.checkpoint.dir names.

    Where that is unset too, a folder of this machine will do if the whole of Spark runs in this process; else ValueError.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


#: Rows of one file where the number of rows is bounded: small tables are written in few files, whatever the number of shuffle partitions.
ROWS_OF_FILE = 250_000


def _in_few_files(df: DataFrame, most_rows: int | None) -> DataFrame:
    return df if most_rows is None else df.coalesce(max(1, math.ceil(most_rows / ROWS_OF_FILE)))


def checkpointed(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The rows, written to the shared folder, without the lineage that made them. most_rows: a bound of their number, if known."""
    shared_folder(df.sparkSession)
    return _in_few_files(df, most_rows).checkpoint(eager=True)


def stored(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again: for wide or many rows, as checkpoints are not compressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    _in_few_files(df, most_rows).write.parquet(path)
    return df.sparkSession.read.parquet(path)
