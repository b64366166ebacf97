"""Input tables and the shared working folder of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet table of the folder, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only where the session names none and has no executors elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table of ids may be broadcast; beyond it, joins shuffle.
BROADCAST_IDS = 500_000


def bounded(ids: DataFrame) -> DataFrame:
    """Write a narrow table; mark it for broadcast if it is small enough."""
    held = saved(ids, "ids")
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


#: A key of a 1/HEAVY part of all rows or more is heavy, so there are at most so many heavy keys.
HEAVY = 10_000


def lookup(rows: DataFrame, found: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Left join of ``rows`` (a written table) with one row of ``found`` for each key, whose ``weight`` says how many rows meet it.

    Rows of heavy keys meet a broadcast table of at most HEAVY keys; only the others are dealt by their key.
    """
    total = found.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    least = max(1000, -(-int(total) // HEAVY))
    heavy = saved(found.where(F.col(weight) >= least), "heavy")
    light = found.where(F.col(weight) < least)
    if heavy.isEmpty():
        return rows.join(light, on, "left")
    heavy = F.broadcast(heavy)
    rest = rows.join(heavy.select(*on), on, "left_anti")
    return rows.join(heavy, on).unionByName(rest.join(light, on, "left"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
