"""Whether a snapshot may serve a query: freshness, coverage and reasons, for many snapshots at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIGURATION = ("configuration", "toolchain", "rules")


def covers(actual: Column, wanted: Column, actual_kind: Column, wanted_kind: Column) -> Column:
    """A full scope covers every scope; a selected one those whose files it has, never a full one."""
    return (actual_kind == "full") | ((wanted_kind == "selected") & (F.size(F.array_except(wanted, actual)) == 0))


def evaluate(snapshots: DataFrame, requirements: DataFrame, sources: DataFrame) -> DataFrame:
    """State of each snapshot: snapshot_id, state, snapshot_state, coverage, can_bind, reasons (sorted).

    snapshots: snapshot_id, repository, revision, scope_kind, scope_files, source_sha256, build_sha256, verified, artifacts_ok,
    attempt (null, building, failed, cancelled) and the columns of CONFIGURATION; requirements: snapshot_id with repository,
    revision, scope_kind, scope_files and CONFIGURATION; sources: snapshot_id with repository, revision, sha256, dirty,
    untracked. Unknown outweighs stale, stale outweighs fresh; a running or failed attempt replaces only ``state``. A
    snapshot without a requirement or source is unknown.
    """
    rows = snapshots.alias("s").join(requirements.alias("r"), "snapshot_id", "left").join(sources.alias("o"), "snapshot_id", "left")
    c = F.col
    no = lambda x: F.coalesce(x, F.lit(False))
    unknown = {
        "artifact_unavailable": ~no(c("s.artifacts_ok")), "unverified_provenance": ~no(c("s.verified")) | no(c("o.untracked")) | ~c("s.build_sha256").eqNullSafe(c("s.source_sha256")),
        "unknown_revision": c("s.revision").isNull() | c("r.revision").isNull() | (c("o.sha256").isNotNull() & c("o.revision").isNull()), "repository_mismatch": ~c("s.repository").eqNullSafe(c("r.repository")) | no(c("o.repository") != c("s.repository")),
        "source_unavailable": c("o.sha256").isNull(),
    }
    stale = {
        "revision_mismatch": ~c("s.revision").eqNullSafe(c("r.revision")) | (c("o.sha256").isNotNull() & ~c("o.revision").eqNullSafe(c("s.revision"))), "dirty_workspace": no(c("o.dirty")), "source_drift": no(c("o.sha256") != c("s.source_sha256")),
        "configuration_mismatch": ~c("s.configuration").eqNullSafe(c("r.configuration")), "toolchain_mismatch": ~c("s.toolchain").eqNullSafe(c("r.toolchain")), "rule_version_mismatch": ~c("s.rules").eqNullSafe(c("r.rules")),
    }
    enough = no(covers(c("s.scope_files"), c("r.scope_files"), c("s.scope_kind"), c("r.scope_kind")))
    attempt = {"latest_building": c("s.attempt") == "building", "latest_failed": c("s.attempt").isin("failed", "cancelled")}
    reasons = F.array_sort(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in (unknown | stale | attempt | {"scope_insufficient": ~enough}).items()))))
    any_of = lambda tests: F.greatest(*(t.cast("int") for t in tests.values())) == 1
    own = F.when(any_of(unknown), "unknown").when(any_of(stale), "stale").otherwise("fresh")
    state = F.when(attempt["latest_building"], "building").when(attempt["latest_failed"], "failed").otherwise(own)
    return rows.select("snapshot_id", state.alias("state"), own.alias("snapshot_state"), F.when(enough, "sufficient").otherwise("insufficient").alias("coverage"), ((state == "fresh") & enough).alias("can_bind"), reasons.alias("reasons"))


def refresh_outcome(states: DataFrame, requests: DataFrame) -> DataFrame:
    """What a refresh of each snapshot does: snapshot_id, outcome.

    requests: snapshot_id, forced, leased (another writer holds it), clean. conflict if leased, rejected if the tree isn't
    clean, no_op if it is fresh and sufficient and not forced, else build.
    """
    rows = requests.join(states, "snapshot_id", "left")
    return rows.select("snapshot_id", F.when(F.col("leased"), "conflict").when(~F.col("clean"), "rejected").when(F.coalesce("can_bind", F.lit(False)) & ~F.col("forced"), "no_op").otherwise("build").alias("outcome"))


def resolved_scope(tracked: DataFrame, kind: str, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files in scope, selected paths that aren't tracked or are excluded) of a full or selected scope over tracked files (path)."""
    from factgraph.functions import paths

    allowed = tracked.where(paths.valid("path") & paths.excluded_directory("path").isNull()).select("path").distinct()
    if kind == "full":
        return allowed, allowed.where(F.lit(False))
    wanted = selected.select("path").distinct()
    return wanted.join(allowed, "path", "left_semi"), wanted.join(allowed, "path", "left_anti")


def artifact_problems(artifacts: DataFrame, stored: DataFrame, index_files: DataFrame, scope: DataFrame) -> DataFrame:
    """kind and path of what makes a snapshot's artifacts unusable.

    artifacts: path, sha256, schema_version; stored: path, sha256, schema_version as found. missing_artifact, hash_mismatch,
    schema_mismatch, and scope_not_indexed for files in scope that the index doesn't name.
    """
    both = artifacts.join(stored.select("path", F.col("sha256").alias("have"), F.col("schema_version").alias("version")), "path", "left")
    kind = F.when(F.col("have").isNull(), "missing_artifact").when(F.col("have") != F.col("sha256"), "hash_mismatch").when(F.col("version") != F.col("schema_version"), "schema_mismatch")
    loose = scope.select("path").distinct().join(index_files.select("path"), "path", "left_anti")
    return both.select(kind.alias("kind"), "path").where("kind is not null").union(loose.select(F.lit("scope_not_indexed"), "path"))
