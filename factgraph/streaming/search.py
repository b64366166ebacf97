"""Text search and change detection over files that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators import textsearch


def matches(files: DataFrame, query: textsearch.TextQuery) -> DataFrame:
    """Matches of each arriving file (path, content); a stream has no order, so a limit isn't possible."""
    if query.limit is not None:
        raise textsearch.QueryError("a stream of files has no first matches")
    return textsearch.search(files, query)


def versions(files: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Distinct (path, sha256, modified) of arriving versions; late repeats within the watermark are dropped."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "modified").withWatermark("modified", watermark).dropDuplicatesWithinWatermark(["path", "sha256"])
