"""Context materialization: candidates with what they depend on, subgraph buckets, and source snippets with their status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators import snippets
from factgraph.sources.workspace import written

#: Bucket of each candidate kind.
BUCKETS = {"node": "nodes", "relation": "relations", "association": "associations", "binding": "bindings"}
MAX_FILE_BYTES = 4 * 1024 * 1024


def buckets(candidates: DataFrame) -> DataFrame:
    """candidate_id, kind and its bucket; every other kind is supporting."""
    bucket = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in BUCKETS.items() for x in pair)), F.col("kind")), F.lit("supporting"))
    return candidates.select("candidate_id", "kind", bucket.alias("bucket"))


def node_places(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Ranges that node candidates inherit from the facts seen of the same identity on the same side.

    nodes: candidate_id, side, identity; facts: side, identity, place (struct or string, null without one). Rows candidate_id,
    places (sorted), note (endpoint_not_observed, endpoint_source_unresolved or null).
    """
    own = facts.groupBy("side", "identity").agg(F.array_sort(F.collect_set("place")).alias("places"), F.lit(True).alias("seen"))
    note = F.when(F.col("seen").isNull(), "endpoint_not_observed").when(F.size("places") == 0, "endpoint_source_unresolved")
    return nodes.join(own, ["side", "identity"], "left").select("candidate_id", F.coalesce("places", F.array().cast(own.schema["places"].dataType)).alias("places"), note.alias("note"))


def closure(candidates: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate ids with all they depend on, dependencies that no candidate is) from dependencies (candidate_id, needs).

    Each round follows one more step for all of them, until no step leads to anything new; dependencies may form circles.
    """
    reached = frontier = written(candidates.select(F.col("candidate_id").alias("root"), "candidate_id").distinct())
    while True:
        step = frontier.join(dependencies, "candidate_id").select("root", F.col("needs").alias("candidate_id")).distinct().join(reached, ["root", "candidate_id"], "left_anti")
        frontier = written(step)
        if frontier.isEmpty():
            return reached, dependencies.join(candidates.select(F.col("candidate_id").alias("needs")), "needs", "left_anti")
        reached = reached.union(frontier)


def snippet_statuses(wanted: DataFrame, sources: DataFrame, max_bytes: int = MAX_FILE_BYTES, max_chars: int = snippets.MAX_BACKING) -> DataFrame:
    """Status and text of each candidate's source range.

    wanted: candidate_id, snapshot (null without one), bound (whether its session is the bound one; null without a session),
    path, start_line, start_column, end_line, end_column, sha256 (of the observation); sources: snapshot, path, content,
    sha256 (of the binding), readable. Statuses: range_missing, source_unavailable, binding_mismatch, source_hash_mismatch,
    range_invalid, materialization_limit, available. A backing is the text of overlapping ranges of one file; rows have its
    id and the range's offsets in it.
    """
    s = sources.select("snapshot", "path", "content", F.col("sha256").alias("bound_sha256"), "readable", F.octet_length("content").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("own_sha256"))
    rows = wanted.join(s.drop("content"), ["snapshot", "path"], "left")
    early = (
        F.when(F.col("path").isNull() | F.col("start_line").isNull(), "range_missing").when(F.col("snapshot").isNull() | F.col("bound").isNull(), "source_unavailable").when(~F.col("bound"), "binding_mismatch")
        .when(~F.coalesce("readable", F.lit(False)), "source_unavailable").when(F.col("bytes") > max_bytes, "materialization_limit")
        .when(~F.col("own_sha256").eqNullSafe(F.col("bound_sha256")) | ~F.col("sha256").eqNullSafe(F.col("bound_sha256")), "source_hash_mismatch")
    )
    rows = rows.withColumn("early", early).drop("readable", "bytes", "own_sha256", "bound_sha256")
    good = rows.where("early is null")
    files = sources.join(good.select("snapshot", "path").distinct(), ["snapshot", "path"], "left_semi").withColumn("file", F.concat_ws("\u0000", "snapshot", "path"))
    lines = snippets.line_offsets(files.select(F.col("file").alias("path"), "content")).withColumnRenamed("path", "file")
    # a line's room: a place behind its last character is valid, as is the first of the line behind the last
    room = lines.withColumn("next", F.lead("offset").over(Window.partitionBy("file").orderBy("line"))).join(files.select("file", F.length("content").alias("size")), "file").withColumn("until", F.coalesce(F.col("next") - 1, F.col("size")))
    at = good.withColumn("file", F.concat_ws("\u0000", "snapshot", "path"))
    for side in ("start", "end"):
        own = room.select("file", F.col("line").alias(f"{side}_line"), F.col("offset").alias(f"{side}_base"), F.col("until").alias(f"{side}_until"))
        at = at.join(own, ["file", f"{side}_line"], "left").withColumn(f"{side}_at", F.when((F.col(f"{side}_column") >= 1) & (F.col(f"{side}_base") + F.col(f"{side}_column") - 1 <= F.col(f"{side}_until")), F.col(f"{side}_base") + F.col(f"{side}_column") - 1))
    valid = F.col("start_at").isNotNull() & F.col("end_at").isNotNull() & (F.col("start_at") <= F.col("end_at"))
    spans = snippets.clusters(at.where(valid).select("file", F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.col("candidate_id").alias("id")), ["file"], max_chars)
    text = spans.join(files.select("file", "content"), "file").select(F.col("id").alias("candidate_id"), F.when(F.col("status") == "limit", "materialization_limit").otherwise("available").alias("status"), F.when(F.col("status") != "limit", F.sha2(F.concat_ws("\u0000", "file", "cluster_start", "cluster_end"), 256)).alias("backing_id"), F.when(F.col("status") != "limit", F.col("start") - F.col("cluster_start")).alias("start_offset"), F.when(F.col("status") != "limit", F.col("end") - F.col("cluster_start")).alias("end_offset"), F.when(F.col("status") != "limit", F.expr("substring(content, cast(start + 1 as int), cast(end - start as int))")).alias("snippet"))
    empty = [F.lit(None).cast("string").alias("backing_id"), F.lit(None).cast("long").alias("start_offset"), F.lit(None).cast("long").alias("end_offset"), F.lit(None).cast("string").alias("snippet")]
    refused = rows.where("early is not null").select("candidate_id", F.col("early").alias("status"), *empty)
    invalid = at.where(~valid).select("candidate_id", F.lit("range_invalid").alias("status"), *empty)
    return refused.unionByName(invalid).unionByName(text)


def broken_invariants(candidates: DataFrame, dependencies: DataFrame, statuses: DataFrame) -> DataFrame:
    """invariant and candidate_id of what an output must not have: open dependencies, repeated ids, snippets of no candidate or with offsets outside their backing."""
    known = candidates.select("candidate_id").distinct()
    open_ = dependencies.join(known.select(F.col("candidate_id").alias("needs")), "needs", "left_anti").select(F.lit("open_dependency").alias("invariant"), "candidate_id")
    twice = candidates.groupBy("candidate_id").count().where("count > 1").select(F.lit("repeated_id"), "candidate_id")
    loose = statuses.join(known, "candidate_id", "left_anti").select(F.lit("snippet_without_candidate"), "candidate_id")
    wrong = statuses.where("status = 'available' and (start_offset < 0 or end_offset < start_offset or length(snippet) <> end_offset - start_offset)").select(F.lit("offset_outside_backing"), "candidate_id")
    return open_.union(twice).union(loose).union(wrong).distinct()


def inventory(observations: DataFrame) -> DataFrame:
    """Counts over observations (seed, kind, item, path): nodes, edges and files, each distinct, and paths, for each seed."""
    count = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("item")))
    return observations.groupBy("seed").agg(count("node").alias("nodes"), count("edge").alias("edges"), F.count_distinct("path").alias("files"), F.count_if(F.col("kind") == "path").alias("paths"))
