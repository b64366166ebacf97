"""Source snippets: offsets of positions, and clusters of overlapping spans that share one backing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BACKING = 65_536


def line_offsets(files: DataFrame) -> DataFrame:
    """path, line, offset: 0-based code-point offset where each line begins, the end of the file as one line more."""
    # only the lengths of the lines leave the scan; a line's offset is their sum in front of it
    lengths = files.select("path", F.length("content").alias("size"), F.concat(F.array(F.lit(-1)), F.transform(F.split("content", "\n"), F.length)).alias("lengths"))
    rows = lengths.select("path", "size", F.posexplode("lengths").alias("at", "length"))
    so_far = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.withColumn("offset", F.sum(F.col("length") + 1).over(so_far))
    return starts.where("at = 0 or offset <= size").select("path", (F.col("at") + 1).cast("long").alias("line"), F.col("offset").cast("long").alias("offset"))


def position_offsets(positions: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``offset`` to positions (path, line, column); null where the file has no such line."""
    return positions.join(line_offsets(files), ["path", "line"], "left").withColumn("offset", F.col("offset") + F.col("column") - 1)


def clusters(spans: DataFrame, group: list[str], max_chars: int = MAX_BACKING) -> DataFrame:
    """Spans (group, start, end, id) in clusters: one joins if it begins before the furthest end so far; touching ones stay apart.

    Adds cluster (1-based), cluster_start, cluster_end and status: available, or limit for every span of a cluster that is
    too long. Spans that are the same in all four meet only others: if nothing before them reaches into them, each counts
    as a cluster and all have the last one's number. Spans without a group or a start meet nothing; nulls come last.
    """
    columns = ("start", "end", "id")
    w = Window.partitionBy(*group).orderBy(*(F.col(c).asc_nulls_last() for c in columns))
    # how many spans are the same, and how many of them stand in front: what comes before the first of them counts for all
    same = Window.partitionBy(*group, *columns)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_reach", reach)
    rows = rows.withColumn("_reach", F.when(F.count_if(F.col("_reach").isNull()).over(same) == 0, F.min("_reach").over(same)))
    meets = F.col("_reach") > F.col("start")
    for c in group:
        meets = meets & F.col(c).isNotNull()
    rows = rows.withColumn("fresh", F.when(F.coalesce(meets, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("cluster", F.sum("fresh").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_reach")
    own = Window.partitionBy(*group, "cluster")
    rows = rows.withColumn("cluster_start", F.min("start").over(own)).withColumn("cluster_end", F.max("end").over(own)).drop("fresh")
    return rows.withColumn("status", F.when(F.col("cluster_end") - F.col("cluster_start") > max_chars, "limit").otherwise("available"))


def materialized(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Text of each span of available clusters (path, start, end, id): one read of a file for all its spans."""
    return clusters(spans, ["path"]).join(files.select("path", "content"), "path", "left").withColumn("snippet", F.when((F.col("status") == "available") & F.col("content").isNotNull(), F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")))).withColumn("status", F.when(F.col("content").isNull(), "missing_source").otherwise(F.col("status"))).drop("content")
