"""Versioned snapshots: generations of Parquet tables, published by replacing one manifest; freshness of what is published."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators.changes import drift
from factgraph.operators.index import FactError

#: Versions that a reader accepts.
SCHEMAS = {"symbol": 3, "graph": 1, "domain": 1}
STATES = ("fresh", "stale", "unknown", "building", "failed")


@dataclass(frozen=True)
class Snapshot:
    """One published generation."""

    repository: str
    revision: str | None
    generation: str
    scope: str
    source_sha256: str
    configuration_sha256: str
    schemas: dict[str, int] = field(default_factory=lambda: dict(SCHEMAS))
    tables: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    """The last usable snapshot and the latest attempt (running, succeeded, failed, cancelled)."""

    last_usable: Snapshot | None = None
    latest_attempt: str | None = None


def fingerprint(inventory: DataFrame) -> str:
    """Digest of an inventory, whatever its order: the driver sees one number."""
    parts = inventory.select(F.xxhash64("path", "sha256").cast("decimal(38,0)").alias("a"), F.xxhash64("sha256", "path").cast("decimal(38,0)").alias("b"))
    row = parts.agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest()


LEASE_SECONDS = 6 * 3600


class SnapshotStore:
    """Snapshots of a folder that Spark's file system reaches; the manifest is replaced by a rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        return self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0] if self._fs.exists(at) else None

    def manifest(self) -> Manifest:
        raw = self._text("manifest.json")
        if raw is None:
            return Manifest()
        data = json.loads(raw, object_pairs_hook=_unique)
        last = data["last_usable"]
        return Manifest(Snapshot(**(last | {"tables": tuple(last["tables"])})) if last else None, data["latest_attempt"])

    def _replace(self, manifest: Manifest) -> None:
        draft, final = self._path(f"{self.root}/manifest.json.new"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(manifest), sort_keys=True).encode()))
        out.close()
        # one step: readers see the old manifest or the new one
        spark = self.spark.sparkContext
        options = spark._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)

    def _lease(self) -> None:
        """Take the writer's lock; one that is older than LEASE_SECONDS was left by a writer that died."""
        lease = self._path(f"{self.root}/writer.lock")
        self._fs.mkdirs(self._path(self.root))
        if not self._fs.createNewFile(lease):
            age = time.time() - self._fs.getFileStatus(lease).getModificationTime() / 1000
            if age < LEASE_SECONDS:
                raise FactError("another writer holds the snapshot folder")
            self._fs.delete(lease, False)
            if not self._fs.createNewFile(lease):
                raise FactError("another writer holds the snapshot folder")

    def publish(self, snapshot: Snapshot, tables: dict[str, DataFrame]) -> Manifest:
        """Write a new generation beside the others, then point the manifest at it; a failure leaves the last usable one."""
        self._lease()
        before = self.manifest()
        try:
            self._replace(Manifest(before.last_usable, "building"))
            for name, rows in tables.items():
                rows.write.parquet(f"{self.root}/{snapshot.generation}/{name}")
            done = Manifest(Snapshot(**(asdict(snapshot) | {"tables": tuple(sorted(tables))})), "succeeded")
            self._replace(done)
            return done
        except BaseException:
            self._replace(Manifest(before.last_usable, "failed"))
            raise
        finally:
            self._fs.delete(self._path(f"{self.root}/writer.lock"), False)

    def read(self, name: str) -> DataFrame:
        """A table of the last usable generation, whose files never change."""
        last = self.manifest().last_usable
        if last is None or name not in last.tables:
            raise FactError("no usable snapshot has this table")
        if last.schemas != SCHEMAS:
            raise FactError("the snapshot has another schema version")
        return self.spark.read.parquet(f"{self.root}/{last.generation}/{name}")


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise FactError("a key stands twice")
    return out


def freshness(manifest: Manifest, repository: str, revision: str | None, source_sha256: str | None, configuration_sha256: str, scope: str = "selected") -> tuple[str, str, str, tuple[str, ...]]:
    """(state, snapshot state, coverage, reasons). Unknown outweighs stale, stale outweighs fresh; a running or failed attempt changes the state alone."""
    last, reasons, unknown, stale = manifest.last_usable, [], False, False
    coverage = "unknown"
    if last is None:
        unknown = True
        reasons.append("no_usable_snapshot")
    else:
        coverage = "sufficient" if scope == "selected" or last.scope == "full" else "insufficient"
        checks = [
            (coverage == "insufficient", "scope_insufficient", ""), (last.revision is None or revision is None, "unknown_revision", "unknown"), (last.repository != repository, "repository_mismatch", "unknown"),
            (source_sha256 is None, "source_unavailable", "unknown"), (last.revision != revision, "revision_mismatch", "stale"), (source_sha256 not in (None, last.source_sha256), "source_drift", "stale"),
            (last.configuration_sha256 != configuration_sha256, "configuration_mismatch", "stale"), (last.schemas != SCHEMAS, "rule_version_mismatch", "stale"),
        ]
        for hit, reason, effect in checks:
            if hit:
                reasons.append(reason)
                unknown |= effect == "unknown"
                stale |= effect == "stale"
    own = "unknown" if unknown else "stale" if stale else "fresh"
    state = {"building": "building", "failed": "failed", "cancelled": "failed"}.get(manifest.latest_attempt or "", own)
    return state, own, coverage, tuple(reasons)


__all__ = ["Manifest", "Snapshot", "SnapshotStore", "drift", "fingerprint", "freshness"]
