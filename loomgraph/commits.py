"""Versions of a folder that appear whole or not at all: a manifest a version, put in place by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """Manifests under `path/_versions`, by number. Data files lie beside them and are never changed; a manifest names those of
    its version. A writer first claims the next number, by creating a file that only one can create, then writes
    its data, then the manifest under another name, and renames it. Stopped before the rename it leaves a claim and
    files that no version names; `abandon` removes the claim. Works on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), f"{path.rstrip('/')}/_versions"

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self) -> list[str]:
        fs, place = self._fs(self.folder)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names() if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        fs, place = self._fs(f"{self.folder}/{version:010d}.json")
        if not version or not fs.exists(place):
            raise ValueError(f"{self.path} has no version {version}")
        stream = fs.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def claim(self, after: int) -> int:
        """The number after `after`, if nobody has it or works on it; ValueError otherwise."""
        fs, place = self._fs(f"{self.folder}/{after + 1:010d}.claim")
        if self.latest() != after or not fs.createNewFile(place):
            raise ValueError(f"{self.path} was changed, or is being changed, after version {after}")
        return after + 1

    def commit(self, version: int, manifest: dict) -> None:
        fs, place = self._fs(f"{self.folder}/{version:010d}.json")
        _, draft = self._fs(f"{self.folder}/.{version:010d}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(place) or not fs.rename(draft, place):
            raise ValueError(f"{self.path} has version {version} already")

    def abandon(self, version: int) -> None:
        """Gives a claim back that no manifest followed."""
        fs, place = self._fs(f"{self.folder}/{version:010d}.claim")
        if version in self.versions():
            raise ValueError(f"version {version} is there")
        fs.delete(place, False)

    def remove(self, path: str) -> None:
        fs, place = self._fs(path)
        fs.delete(place, True)

    def listed(self, path: str) -> list[str]:
        fs, place = self._fs(path)
        return [str(s.getPath().getName()) for s in fs.listStatus(place)] if fs.exists(place) else []
