"""Graphs at rest: Parquet of nodes and edge evidence, a folder for each repository and snapshot."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import graph
from factgraph.operators.index import FactError


class GraphStore:
    """Scopes are told apart by digests; a graph is checked before it is written and never merged with another."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, repository: str, snapshot: str) -> str:
        return "/".join([self.root, *(hashlib.sha256(x.encode()).hexdigest() for x in (repository, snapshot))])

    def save(self, repository: str, snapshot: str, nodes: DataFrame, evidence: DataFrame) -> str:
        nodes, _ = graph.checked(nodes, evidence)
        at = self.path(repository, snapshot)
        scope = [F.lit(repository).alias("repository"), F.lit(snapshot).alias("snapshot")]
        nodes.select("*", *scope).write.mode("overwrite").parquet(f"{at}/nodes")
        evidence.distinct().select("*", *scope).write.mode("overwrite").parquet(f"{at}/evidence")
        return at

    def load(self, repository: str, snapshot: str) -> tuple[DataFrame, DataFrame]:
        out = []
        for name in ("nodes", "evidence"):
            rows = self.spark.read.parquet(f"{self.path(repository, snapshot)}/{name}")
            if not rows.where((F.col("repository") != repository) | (F.col("snapshot") != snapshot)).isEmpty():
                raise FactError("the stored graph belongs to another scope")
            out.append(rows.drop("repository", "snapshot"))
        return out[0], out[1]

    def delete(self, repository: str, snapshot: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(repository, snapshot))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def encoded(rows: DataFrame) -> DataFrame:
    """Rows as canonical JSON lines: keys in schema order, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def decoded(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines as rows of a closed schema; a line that doesn't fit, or has other keys, fails the read."""
    parsed = lines.select("json", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("row"))
    names = parsed.select("row.*").columns
    odd = parsed.where(F.size(F.array_except(F.json_object_keys("json"), F.array(*map(F.lit, names)))) > 0)
    if not odd.isEmpty():
        raise FactError("a record has keys that its schema lacks")
    return parsed.select("row.*")
