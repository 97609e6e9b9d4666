"""Snapshots of a set of tables: a log of manifests, each published by one atomic rename.

A writer puts new files where no reader looks and then publishes a manifest that names every
file folder of the new state. A reader takes the newest manifest and sees that state as a
whole, whatever fails or goes on beside it. Two writers that start from one state can't both
publish: the rename of the second finds its version taken.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published first; read the new state and try again."""


class SnapshotLog:
    """Manifests below root/_snapshots, in any store that Hadoop's file contexts reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._context = self._fs.FileContext.getFileContext(self._path("").toUri(), conf) if "://" in root else (
            self._fs.FileContext.getFileContext(conf)
        )

    def _path(self, below: str):
        return self._fs.Path(f"{self.root}/{below}" if below else self.root)

    def children(self, below: str) -> list[str]:
        """Names of what lies in a folder, none if it does not exist."""
        path = self._path(below)
        if not self._context.util().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._context.util().listStatus(path))

    def drop(self, below: str) -> None:
        """Delete a folder of the writer's own that no manifest names."""
        self._context.delete(self._path(below), True)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.children("_snapshots") if n.endswith(".json")]

    def read(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the newest; None if nothing was published."""
        known = self.versions()
        if not known:
            return None
        name = f"_snapshots/{known[-1] if version is None else version:012d}.json"
        stream = self._context.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict, after: dict | None) -> dict:
        """Make manifest the newest state, if `after` still is it."""
        version = 0 if after is None else after["version"] + 1
        manifest = manifest | {"version": version}
        draft, final = self._path(f"_drafts/{uuid4().hex}"), self._path(f"_snapshots/{version:012d}.json")
        flags = self._jvm.java.util.EnumSet.of(self._fs.CreateFlag.CREATE)
        options = self._fs.Options
        parents = self._jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        several = self.spark.sparkContext._gateway.new_array(options.CreateOpts, 1)
        several[0] = parents
        out = self._context.create(draft, flags, several)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        self._context.mkdir(final.getParent(), self._fs.permission.FsPermission.getDirDefault(), True)
        never_over = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        never_over[0] = options.Rename.NONE
        try:
            self._context.rename(draft, final, never_over)
        except Py4JJavaError as problem:
            if problem.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {version} of {self.root} was published by another writer") from None
            raise
        return manifest
