"""Where facts come from: a source gives the fact tables as DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "symbols": "identity string, kind string, display_name string, qualified_name string, parent_identity string, namespace_identity string",
    "symbol_ranges": "symbol_identity string, role string, file_path string, start_line long, start_column long, end_line long, end_column long",
    "symbol_references": "symbol_identity string, file_path string, start_line long, start_column long, end_line long, end_column long",
    "symbol_relations": "source_identity string, relation_kind string, target_identity string",
    "test_entities": "identity string, kind string, display_name string, file_path string, start_line long, start_column long, end_line long, end_column long",
    "test_fixture_cases": "fixture_identity string, case_identity string",
    "test_case_bodies": "case_identity string, file_path string, start_line long, start_column long, end_line long, end_column long",
}


class FactSource(ABC):
    """Gives fact tables by name (those of TABLES); what it doesn't know is an empty table."""

    @abstractmethod
    def table(self, name: str) -> DataFrame: ...

    def close(self) -> None:
        """Release what the source holds."""

    def symbols_in_file(self, path: str) -> DataFrame:
        own = self.table("symbol_ranges").where(F.col("file_path") == path).select(F.col("symbol_identity").alias("identity"))
        return self.table("symbols").join(own, "identity", "left_semi")

    def place(self, identity: str, role: str) -> DataFrame:
        return self.table("symbol_ranges").where((F.col("symbol_identity") == identity) & (F.col("role") == role))

    def references(self, identity: str) -> DataFrame:
        return self.table("symbol_references").where(F.col("symbol_identity") == identity).distinct()

    def related(self, identity: str, kind: str) -> DataFrame:
        """Callers or callees, as recorded for this symbol."""
        return self.table("symbol_relations").where((F.col("source_identity") == identity) & (F.col("relation_kind") == kind)).distinct()


class ParquetFacts(FactSource):
    """Facts that were landed as one Parquet folder for each table; columns are read by the fixed schema."""

    def __init__(self, spark: SparkSession, root: str, tables: tuple[str, ...] = tuple(TABLES)):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose length and modification time were the same before and after they were read (path, length, modified)."""
    return before.join(after, ["path", "length", "modified"], "left_semi")
