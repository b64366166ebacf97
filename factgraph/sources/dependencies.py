"""Compile contexts and dependency metadata: identities, coverage, and which depfile serves which translation unit."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.sources.files import depfile_rules
from factgraph.sources.workspace import dealt, written

COVERAGES = ("complete", "partial", "unknown")


def context_identity(source: Column, directory: Column, arguments: Column, inputs: Column) -> Column:
    """Identity of a compile context: source, directory, arguments and the configuration inputs (path and hash) in order."""
    return F.concat(F.lit("compile-context:sha256:"), F.sha2(F.to_json(F.struct(arguments.alias("arguments"), inputs.alias("configuration_inputs"), F.lit(1).alias("schema_version"), source.alias("source"), directory.alias("working_directory"))), 256))


def unit_identity(source: Column, context: Column) -> Column:
    """Identity of a translation unit: its source in one context."""
    return F.concat(F.lit("tu:sha256:"), F.sha2(F.to_json(F.struct(context.alias("compile_context"), F.lit(1).alias("schema_version"), source.alias("source"))), 256))


def units(contexts: DataFrame) -> DataFrame:
    """contexts: source, directory, arguments, inputs. Adds context, tu and how many contexts the source has; equal contexts are one."""
    own = contexts.distinct().withColumn("context", context_identity(F.col("source"), F.col("directory"), F.col("arguments"), F.col("inputs")))
    own = own.withColumn("tu", unit_identity(F.col("source"), F.col("context")))
    return own.join(own.groupBy("source").agg(F.count("*").alias("contexts")), "source")


def split_command(rows: DataFrame, column: str = "command") -> DataFrame:
    """Adds ``arguments``: a shell command's words, null where quotes don't close."""
    schema = rows.select("*", F.array(F.lit("")).alias("arguments")).schema
    names = rows.columns

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(column).to_pylist():
                try:
                    out.append(None if text is None else shlex.split(text))
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.list_(pa.string()))], names=[*names, "arguments"])

    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(words, schema)


def registered(contexts: DataFrame, by_unit: DataFrame, by_source: DataFrame) -> DataFrame:
    """tu, source, depfile of each unit: that of the unit itself, or that of its source if the source has one context only; else null.

    contexts: tu, source; by_unit: tu, depfile; by_source: source, depfile.
    """
    pairs = dealt(contexts.select("tu", "source"), contexts.count(), "source").distinct()
    # units of a source lie in one partition, so they are counted where they are
    counts = pairs.groupBy("source").agg(F.count("tu").alias("contexts"))
    rows = pairs.join(counts, "source").join(by_unit.select("tu", F.col("depfile").alias("own")), "tu", "left").join(by_source.select("source", F.col("depfile").alias("shared")), "source", "left")
    return rows.select("tu", "source", F.coalesce("own", F.when(F.col("contexts") == 1, F.col("shared"))).alias("depfile"))


def closures(contexts: DataFrame, by_unit: DataFrame, by_source: DataFrame, depfiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tu, path) of everything each unit is made of, its source included, and diagnostics (tu, code, n).

    depfiles: path, content of Make dependency files. Dependencies outside the tree are counted, not kept; a unit without a
    depfile has none.
    """
    from factgraph.functions import paths

    chosen = written(registered(contexts, by_unit, by_source))
    n = max(chosen.count(), depfiles.count())
    # both sides of the join are dealt to the same partitions, as many as the rows fill
    texts = dealt(depfiles.select(F.col("path").alias("depfile"), "content"), n, "depfile")
    found = written(dealt(chosen.where("depfile is not null"), n, "depfile").join(texts.hint("merge"), "depfile", "left"))
    # a unit's texts are read where they are, each unit with its own
    read = found.where("content is not null")
    every = depfile_rules(read.select(F.struct("tu", "depfile").alias("path"), "content")).select("path.tu", "path.depfile", "dependency")
    every = dealt(every, n, "tu").distinct()
    inside = paths.valid("dependency")
    rows = dealt(every.where(inside).select("tu", F.col("dependency").alias("path")).union(read.select("tu", F.col("source").alias("path"))), n, "tu").distinct()
    outside = every.where(~inside).groupBy("tu").agg(F.count("*").alias("n")).select("tu", F.lit("outside_repository_dependency").alias("code"), "n")
    missing = chosen.where("depfile is null").select("tu", F.lit("missing_dependency_metadata").alias("code"), F.lit(1).cast("long").alias("n"))
    broken = found.where("content is null").select("tu", F.lit("malformed_metadata").alias("code"), F.lit(1).cast("long").alias("n"))
    return rows, outside.union(missing).union(broken)


def widest(coverages: DataFrame, column: str = "coverage", by: list[str] | None = None) -> DataFrame:
    """The worst coverage of each group: unknown over partial over complete."""
    rank = F.array_position(F.array(*map(F.lit, COVERAGES)), F.col(column))
    return coverages.groupBy(*(by or [])).agg(F.element_at(F.array(*map(F.lit, COVERAGES)), F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("coverage"))


def unit_coverage(contexts: DataFrame, records: DataFrame) -> DataFrame:
    """Units on one side only: tu and whether it is ``missing`` (a context without dependencies) or ``unexpected``."""
    both = contexts.select("tu", F.lit(1).alias("want")).distinct().join(records.select("tu", F.lit(1).alias("have")).distinct(), "tu", "full")
    return both.where("want is null or have is null").select("tu", F.when(F.col("have").isNull(), "missing").otherwise("unexpected").alias("mismatch"))


def change_problems(changes: DataFrame) -> DataFrame:
    """Normalized changes (old_path, new_path, kind; distinct) with ``problem``: kind_disagrees, conflicting_old_path, conflicting_new_path or null."""
    c = F.col
    rows = changes.select("old_path", "new_path", "kind").distinct()
    agrees = (
        F.when(c("kind") == "add", c("old_path").isNull() & c("new_path").isNotNull()).when(c("kind") == "delete", c("old_path").isNotNull() & c("new_path").isNull())
        .when(c("kind") == "modify", F.coalesce(c("old_path") == c("new_path"), F.lit(False))).when(c("kind") == "rename", F.coalesce(c("old_path") != c("new_path"), F.lit(False))).otherwise(False)
    )
    for side in ("old", "new"):
        many = rows.where(c(f"{side}_path").isNotNull()).groupBy(f"{side}_path").agg((F.count("*") > 1).alias(f"{side}_twice"))
        rows = rows.join(many, f"{side}_path", "left")
    problem = F.when(~agrees, "kind_disagrees").when(F.coalesce("old_twice", F.lit(False)), "conflicting_old_path").when(F.coalesce("new_twice", F.lit(False)), "conflicting_new_path")
    return rows.select("old_path", "new_path", "kind", problem.alias("problem"))


def normalized_changes(changes: DataFrame) -> DataFrame:
    """The distinct changes in order; one problem refuses them all."""
    from factgraph.operators.index import refuse

    found = change_problems(changes)
    refuse(found.where("problem is not null").select(F.concat_ws(" ", "problem", "old_path", "new_path").alias("p")), "p", "changes conflict")
    return found.drop("problem").orderBy(F.coalesce("old_path", F.lit("")), F.coalesce("new_path", F.lit("")), "kind")
