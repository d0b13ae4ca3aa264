"""A small versioned table for streams: buckets that are replaced as a whole, and a manifest that says which version counts.

Layout: `version=<batch>/bucket=<b>/` holds rows, `_manifest/<batch>` names the version of every bucket. A manifest is written beside its
place and renamed, so it is there whole or not at all; a batch that is repeated before its commit overwrites its own version, one that is
repeated after it is recognised. A replaced version stays until the next commit, for readers that still use the manifest before.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from codegauge.sources.folders import Folder


@dataclass
class Manifest:
    batch: int = -1
    versions: dict[str, int] = field(default_factory=dict)  # by bucket
    replaced: list[str] = field(default_factory=list)  # folders to be removed with the next commit


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def manifest(self) -> Manifest:
        done = [name for name in self.folder.names("_manifest") if name.isdigit()]
        return Manifest(**json.loads(self.folder.read_text(f"_manifest/{done[-1]}"))) if done else Manifest()

    def read(self, manifest: Manifest, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all or some buckets; None where none of them is stored."""
        wanted = manifest.versions if buckets is None else {str(b): None for b in buckets}
        paths = [f"{self.folder.path}/version={manifest.versions[b]}/bucket={b}" for b in wanted if b in manifest.versions]
        return self.spark.read.parquet(*paths) if paths else None

    def replace(self, rows: DataFrame, buckets: list[int], batch: int, manifest: Manifest) -> None:
        """Commits `rows` (with a column `bucket`) as the whole content of the buckets."""
        if buckets:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.path}/version={batch}")
        stored = {int(name.removeprefix("bucket=")) for name in self.folder.names(f"version={batch}") if name.startswith("bucket=")}
        versions = manifest.versions | {str(b): batch for b in buckets if b in stored}
        replaced = [f"version={manifest.versions[str(b)]}/bucket={b}" for b in buckets if str(b) in manifest.versions]
        self._commit(Manifest(batch, versions, replaced))
        for name in manifest.replaced:
            self.folder.delete(name)
        live = {f"version={v}" for v in versions.values()} | {name.split("/")[0] for name in replaced}
        for name in self.folder.names():
            if name.startswith("version=") and name not in live:
                self.folder.delete(name)

    def _commit(self, manifest: Manifest) -> None:
        name = f"{manifest.batch:020d}"
        self.folder.commit_text(f"_manifest/{name}", json.dumps(vars(manifest)))
        for old in self.folder.names("_manifest"):
            if old < name:
                self.folder.delete(f"_manifest/{old}")
