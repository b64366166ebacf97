"""The shared working folder: cutting the lineage of rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def written(df: DataFrame) -> DataFrame:
    """Write the rows to the folder that all executors share and read them again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-rounds-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = kept(spark, f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that ``dealt`` gives a partition about.
DEALT = 200_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows dealt by their keys to as many partitions as they fill, so that no task's memory grows with the table."""
    return rows.repartition(max(1, -(-n // DEALT)), *keys)


#: Folders that each application has written and not removed.
_HELD: dict[str, list[str]] = {}


def kept(spark: SparkSession, path: str) -> str:
    """Note a folder for ``release``."""
    _HELD.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove all folders of rounds that this session has written; results that read them can't be used any more. How many there were."""
    paths = _HELD.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
