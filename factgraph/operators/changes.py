"""Changed ranges, what symbols they touch, and what a change of files makes stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import paths, ranges
from factgraph.operators import intervals
from factgraph.sources.workspace import dealt

LINES = ("start_line", "end_line")
TU_EXTENSIONS = ("c", "cc", "cpp", "cxx", "m", "mm")


def changed_blocks(diff_lines: DataFrame, hunk: list[str]) -> DataFrame:
    """Contiguous runs of added and deleted lines: block, old_start, old_end, new_start, new_end (half open).

    diff_lines: the hunk's columns, seq, kind (context, add, delete, no_newline), old_start and new_start of the hunk. A
    side without lines is a point.
    """
    w = Window.partitionBy(*hunk).orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    rows = diff_lines.where("kind <> 'no_newline'")
    rows = rows.withColumn("old_line", F.col("old_start") + count(F.col("kind").isin("context", "delete"))).withColumn("new_line", F.col("new_start") + count(F.col("kind").isin("context", "add"))).withColumn("island", count(F.col("kind") == "context"))
    edits = rows.where("kind in ('add', 'delete')").groupBy(*hunk, "island").agg(F.min("old_line").alias("old_start"), F.count_if(F.col("kind") == "delete").alias("deleted"), F.min("new_line").alias("new_start"), F.count_if(F.col("kind") == "add").alias("added"))
    return edits.select(*hunk, F.row_number().over(Window.partitionBy(*hunk).orderBy("island")).cast("long").alias("block"), F.col("old_start").cast("long").alias("old_start"), (F.col("old_start") + F.col("deleted")).cast("long").alias("old_end"), F.col("new_start").cast("long").alias("new_start"), (F.col("new_start") + F.col("added")).cast("long").alias("new_end"))


def mapped_symbols(anchors: DataFrame, symbol_ranges: DataFrame) -> DataFrame:
    """Symbols whose extent a changed range meets: anchor_id, symbol_identity, role, relation.

    anchors: anchor_id, file_path, start_line, end_line (whole lines). Ranges that share a line are joined by buckets of
    lines, and the extent test follows.
    """
    a = anchors.select("anchor_id", F.col("file_path").alias("a_file"), "start_line", F.lit(1).alias("start_column"), "end_line", F.lit(1).alias("end_column"))
    extents = symbol_ranges.select("symbol_identity", "role", *ranges.FIELDS)
    met = intervals.overlapping(a, extents, [("a_file", "file_path")], LINES, LINES)
    relation = ranges.extent_relation(ranges.start(met, "left."), ranges.end(met, "left."), ranges.start(met, "right."), ranges.end(met, "right."))
    return met.select("left.anchor_id", "right.symbol_identity", "right.role", relation.alias("relation")).where("relation is not null").distinct()


def mapping_status(anchors: DataFrame, matches: DataFrame, sides: DataFrame, files: DataFrame, symbol_counts: DataFrame | None = None, max_candidates: int = 128, max_ranges: int = 512, max_files: int = 128, max_symbols: int = 10_000) -> DataFrame:
    """Status and reason of each anchor: anchor_id, status, reason, candidates, ambiguous.

    anchors: anchor_id, ordinal, side, file_path (null if the file isn't on this side), start_line, end_line (null without an
    edit); sides: side, revision, session, bound (whether the session is of that revision); files: side, path, in_scope,
    fingerprinted, language_ok, readable, lines; symbol_counts: side, path, symbols.

    Reasons in the order they are looked at: file_absent_on_side (not_applicable); revision_absent, session_absent,
    binding_mismatch, no_edit_range (unresolved); mapping_limit beyond max_ranges (truncated); scope_insufficient,
    source_not_fingerprinted (unresolved); mapping_limit beyond max_files (truncated); unsupported_language (unsupported);
    backend_failure (failure); range_outside_source (unresolved); mapping_limit of symbols or candidates (truncated);
    no_proven_extent (unresolved); intersection_only and null (mapped).
    """
    c = F.col
    n = matches.groupBy("anchor_id").agg(F.count_distinct("symbol_identity").alias("n"), F.bool_or(c("relation") != "intersecting").alias("held"))
    rows = anchors.join(n.hint("merge"), "anchor_id", "left").join(F.broadcast(sides), "side", "left").join(files.select("side", c("path").alias("file_path"), F.lit(True).alias("known"), "in_scope", "fingerprinted", "language_ok", "readable", "lines"), ["side", "file_path"], "left")
    if symbol_counts is not None:
        rows = rows.join(symbol_counts.select("side", c("path").alias("file_path"), "symbols"), ["side", "file_path"], "left")
    else:
        rows = rows.withColumn("symbols", F.lit(0))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    asked = (c("ordinal") <= max_ranges) & c("start_line").isNotNull() & F.coalesce(c("in_scope") & c("fingerprinted"), F.lit(False))
    # a side reads at most so many files, in the order in which anchors ask for them
    first = rows.where(asked).groupBy("side", "file_path").agg(F.min("ordinal").alias("first_asked"))
    placed = first.withColumn("file_no", F.row_number().over(Window.partitionBy("side").orderBy("first_asked", "file_path")))
    rows = rows.join(placed.select("side", "file_path", "file_no"), ["side", "file_path"], "left")
    place = lambda line: (line >= 1) & (line <= c("lines") + 1)
    reason = (
        F.when(c("file_path").isNull(), "file_absent_on_side").when(c("revision").isNull(), "revision_absent").when(no(c("session")), "session_absent").when(no(c("bound")), "binding_mismatch").when(c("start_line").isNull(), "no_edit_range")
        .when(c("ordinal") > max_ranges, "mapping_limit").when(no(c("in_scope")), "scope_insufficient").when(no(c("fingerprinted")), "source_not_fingerprinted").when(c("file_no") > max_files, "mapping_limit").when(no(c("language_ok")), "unsupported_language")
        .when(no(c("readable")), "backend_failure").when(~(place(c("start_line")) & place(c("end_line"))), "range_outside_source").when((F.coalesce("symbols", F.lit(0)) > max_symbols) | (F.coalesce("n", F.lit(0)) > max_candidates), "mapping_limit")
        .when(c("n").isNull(), "no_proven_extent").when(~c("held"), "intersection_only")
    )
    status = F.when(reason == "file_absent_on_side", "not_applicable").when(reason == "mapping_limit", "truncated").when(reason == "unsupported_language", "unsupported").when(reason == "backend_failure", "failure").when(reason.isNull() | (reason == "intersection_only"), "mapped").otherwise("unresolved")
    found = F.when(status.isin("mapped", "truncated") & (c("ordinal") <= max_ranges), F.coalesce("n", F.lit(0))).otherwise(0).cast("long")
    return rows.select("anchor_id", status.alias("status"), reason.alias("reason"), found.alias("candidates"), (found > 1).alias("ambiguous"))


def mapping_seeds(statuses: DataFrame, matches: DataFrame, anchors: DataFrame) -> DataFrame:
    """side, seed_kind and key of the symbols that mapped ranges touch: what each side's retrieval starts from."""
    good = statuses.where("status in ('mapped', 'truncated')").select("anchor_id")
    # anchors are as many as ranges, on either side of these joins
    return matches.join(good.hint("merge"), "anchor_id", "left_semi").join(anchors.select("anchor_id", "side").hint("merge"), "anchor_id").select("side", F.lit("symbol").alias("seed_kind"), F.col("symbol_identity").alias("key")).distinct()


def reverse_dependencies(dependencies: DataFrame) -> DataFrame:
    """path and the sorted units that depend on it."""
    return dependencies.groupBy("path").agg(F.array_sort(F.collect_set("tu")).alias("units"))


def impact(changes: DataFrame, contexts: DataFrame, dependencies: DataFrame, config_inputs: DataFrame) -> DataFrame:
    """Translation units that a change makes stale, each with its reasons in order.

    changes: path (old and new alike), contexts: tu, source, side; dependencies: tu, path, side; config_inputs: tu, path.
    Headers invalidate by dependency on both sides, sources by their own units, inputs by the contexts that name them, and
    units that only one side knows are stale without any change.
    """
    ext = paths.extension("path")
    changed = changes.select("path").distinct()
    header = changed.where(ext.isin(*paths.HEADER_EXTENSIONS)).join(dependencies, "path").select("tu", F.lit("header").alias("reason"))
    source = changed.where(ext.isin(*TU_EXTENSIONS)).join(contexts.withColumnRenamed("source", "path"), "path").select("tu", F.lit("source").alias("reason"))
    config = changed.join(config_inputs, "path").select("tu", F.lit("configuration").alias("reason"))
    moved = symmetric_difference(contexts).select("tu", F.lit("context").alias("reason"))
    return header.union(source).union(config).union(moved).distinct().groupBy("tu").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def symmetric_difference(contexts: DataFrame) -> DataFrame:
    """source and tu that only the old or only the new side has."""
    return contexts.select("source", "tu", "side").distinct().groupBy("source", "tu").agg(F.count_distinct("side").alias("n")).where("n = 1").select("source", "tu")


def impact_diagnostics(changes: DataFrame, contexts: DataFrame, dependencies: DataFrame, config_inputs: DataFrame) -> DataFrame:
    """code, path, requires_full_rebuild: sources without context, files of no known use, units without dependencies on a side."""
    ext = paths.extension("path")
    changed = changes.select("path").distinct()
    lone = changed.where(ext.isin(*TU_EXTENSIONS)).join(contexts.select(F.col("source").alias("path")).distinct(), "path", "left_anti").select(F.lit("missing_compile_context").alias("code"), "path", F.lit(True).alias("requires_full_rebuild"))
    other = changed.where(~ext.isin(*TU_EXTENSIONS, *paths.HEADER_EXTENSIONS)).join(config_inputs.select("path").distinct(), "path", "left_anti").select(F.lit("unsupported_changed_file").alias("code"), "path", F.lit(False).alias("requires_full_rebuild"))
    # both sides of the join are dealt to the same partitions, as many as the contexts fill
    n = contexts.count()
    units, known = dealt(contexts.select("tu", "side"), n, "tu", "side").distinct(), dealt(dependencies.select("tu", "side").distinct(), n, "tu", "side")
    bare = units.join(known.hint("merge"), ["tu", "side"], "left_anti").select(F.lit("missing_dependency_metadata").alias("code"), F.concat_ws(":", "side", "tu").alias("path"), F.lit(True).alias("requires_full_rebuild"))
    return lone.union(other).union(bare)


def impact_status(diagnostics: DataFrame, coverage: str, header_changed: bool) -> str:
    """full_rebuild if a diagnostic asks for it, unknown for unknown coverage, else safe."""
    if not diagnostics.where("requires_full_rebuild").isEmpty() or header_changed and coverage != "complete":
        return "full_rebuild"
    return "unknown" if coverage == "unknown" else "safe"


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files that were added, removed or changed between two inventories (path, sha256)."""
    both = old.select("path", F.col("sha256").alias("a")).join(new.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").alias("drift")).where("drift is not null")
