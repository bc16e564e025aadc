"""Versioned storage: immutable Parquet folders, one manifest file per version.

A commit is an attempt with a name of its own: it writes what changed, and its change events, into folders that
no other attempt has, and then creates ``manifest-<version>.json``. Creating it fails if the version is there
already, so of two writers the first wins, with its own data, and the other can try again on the new snapshot.
The winner's events are then moved into the change log; should a writer be lost between the two steps, the next
one to look at the log moves them. Readers see whole versions only. Files go through Hadoop's file systems,
wherever they are.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError
from ..plans.sdl import Schema
from .catalog import Catalog

CHANGES, PENDING = "changes", "pending"
#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._base = self._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._base):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._base)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have:
            return {"version": 0, "next_id": 0, "schema": "", "frames": {}, "retired": [], "migrations": []}
        version = have[-1] if version is None else version
        stream = self._fs.open(self._path(f"manifest-{version:020d}.json"))
        try:
            data = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(data)

    def load(self, version: int | None = None) -> Catalog:
        m = self.manifest(version)
        out = Catalog(Schema.parse(m["schema"]), {}, {}, {}, m["version"])
        for key, folder in m["frames"].items():
            kind, *names = key.split(":")
            df = self.spark.read.parquet(f"{self.root}/{folder}")
            if kind == "o":
                out.objects[names[0]] = df
            else:
                (out.edges if kind == "e" else out.vectors)[names[0], names[1]] = df
        return out

    def commit(self, catalog: Catalog, changed: set[str], next_id: int, changes: DataFrame | None = None, note: dict | None = None) -> Catalog:
        """Make ``catalog`` the next version; ``changed``: keys (o:T, e:T:f, v:T:f) of frames to write."""
        base = self.manifest()
        if base["version"] != catalog.version:
            raise ConflictError(f"version {catalog.version} is not the last any more ({base['version']})")
        version = base["version"] + 1
        attempt = f"v{version:020d}-{uuid.uuid4().hex}"
        frames = dict(base["frames"])
        live = self.keys(catalog)
        for key, df in live.items():
            if key in changed or key not in frames:
                folder = f"data/{key.replace(':', '.')}/{attempt}"
                df.write.parquet(f"{self.root}/{folder}")
                frames[key] = folder
        frames = {k: v for k, v in frames.items() if k in live}
        if changes is not None:
            changes.withColumn("version", F.lit(version).cast("long")).write.parquet(f"{self.root}/{PENDING}/{attempt}")
        manifest = base | {"version": version, "next_id": next_id, "schema": catalog.schema.emit(), "frames": frames, "attempt": attempt} | (note or {})
        self._create(f"manifest-{version:020d}.json", json.dumps(manifest, indent=1))
        self.publish()
        return self.load(version)

    def publish(self) -> str:
        """Move the events of committed versions into the change log; those of refused attempts go. The log's folder."""
        self._fs.mkdirs(self._path(CHANGES))
        if self._fs.exists(self._path(PENDING)):
            have = set(self.versions())
            for name in sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(PENDING))):
                version = int(name[1:21])
                if version not in have:
                    continue  # an attempt that is still under way
                if self.manifest(version).get("attempt") == name:
                    self._fs.rename(self._path(f"{PENDING}/{name}"), self._path(f"{CHANGES}/{name}"))
                else:
                    self._fs.delete(self._path(f"{PENDING}/{name}"), True)
        return f"{self.root}/{CHANGES}"

    def _create(self, name: str, text: str) -> None:
        try:
            out = self._fs.create(self._path(name), False)
        except Exception as e:
            raise ConflictError(f"another writer made {name} first") from e
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    @staticmethod
    def keys(c: Catalog) -> dict[str, DataFrame]:
        return {f"o:{n}": d for n, d in c.objects.items()} | {f"e:{t}:{f}": d for (t, f), d in c.edges.items()} | {f"v:{t}:{f}": d for (t, f), d in c.vectors.items()}

    def compact(self, file_bytes: int = FILE_BYTES) -> Catalog:
        """Rewrite all frames of the last version into files of about ``file_bytes``, as a new version."""
        m, c = self.manifest(), self.load()
        files = {key: max(1, math.ceil(self._fs.getContentSummary(self._path(folder)).getLength() / file_bytes)) for key, folder in m["frames"].items()}
        c.objects = {k: v.coalesce(files[f"o:{k}"]) for k, v in c.objects.items()}
        c.edges = {(t, f): v.coalesce(files[f"e:{t}:{f}"]) for (t, f), v in c.edges.items()}
        c.vectors = {(t, f): v.coalesce(files[f"v:{t}:{f}"]) for (t, f), v in c.vectors.items()}
        return self.commit(c, set(self.keys(c)), m["next_id"])

    def backup(self, target: str, version: int | None = None) -> None:
        """Copy one version - its manifest and the frames it names, by tasks - to another place."""
        m, there = self.manifest(version), Store(self.spark, target)
        for folder in m["frames"].values():
            self.spark.read.parquet(f"{self.root}/{folder}").write.parquet(f"{target}/{folder}")
        there._create(f"manifest-{m['version']:020d}.json", json.dumps(m, indent=1))

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, root: str) -> Store:
        """A store from a backup; into a place that holds versions already it is refused."""
        store = cls(spark, root)
        if store.versions():
            raise ConflictError(f"{root} is not empty")
        cls(spark, backup).backup(root)
        return store
