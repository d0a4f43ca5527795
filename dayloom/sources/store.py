"""Steps that several others read, written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []

#: Rows of a file of steps whose readers deal them out anew, which takes memory for all rows of a task.
FILE_ROWS = 5_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and all run on one machine (tests) a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = _OWN[0]
    return found.rstrip("/")


def stored(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """df written as Parquet and read back: worked out once, pruned by later reads, of known size for joins, and safe from lost executors.

    file_rows: at most so many rows a file, 0 for any number. A task reads a few dozen files at most, so it then has a bounded number of rows.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
