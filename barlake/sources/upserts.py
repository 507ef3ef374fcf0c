"""A table of the newest row of each key, kept by micro-batches, with one version at a time and few folders.

The table is a folder of *parts* (a reduced micro-batch, or a snapshot of all
up to one) and of numbered *manifests*, small text files that list the parts
which make up the table.  A writer puts a new part beside the others and then
moves a new manifest into place; the manifest with the largest number counts,
so readers see a version whole or not at all.  After ``parts`` batches the parts
are merged into a snapshot.  Parts that neither of the last two manifests
names are removed, so readers of the version before go on undisturbed and the
number of folders is bounded.

A repeated micro-batch replaces its own part, or nothing if a snapshot has it.
One writer at a time, as a stream is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from .sinks import latest_by_key

#: Batches that stay apart before they are merged into a snapshot.
PARTS = 8


class UpsertTable:
    """The table below ``path`` with its conflict ``keys``; of equal keys the last row by ``order`` is the newest."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS):
        self.spark, self.path, self.keys, self.order, self.parts = spark, path.rstrip("/"), list(keys), list(order), parts

    def _at(self, name: str) -> JavaObject:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self) -> JavaObject:
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifest") if n.isdigit())

    def _listed(self, version: int) -> list[str]:
        lines = self.spark.read.text(f"{self.path}/manifest/{version}", wholetext=True).first()
        return lines["value"].split() if lines else []

    def listed(self) -> list[str]:
        """The parts of the newest version."""
        versions = self._versions()
        return self._listed(versions[-1]) if versions else []

    def _publish(self, parts: Sequence[str]) -> None:
        fs, versions = self._fs(), self._versions()
        new = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(bytearray("\n".join(parts).encode()))
        out.close()
        if not fs.rename(new, self._at(f"manifest/{(versions or [-1])[-1] + 1}")):
            raise RuntimeError(f"another writer has published a version of {self.path}")
        for version in versions[:-1]:
            fs.delete(self._at(f"manifest/{version}"), False)
        needed = {*parts, *(self._listed(versions[-1]) if versions else [])}
        for name in set(self._names("part")) - {p.removeprefix("part/") for p in needed}:
            fs.delete(self._at(f"part/{name}"), True)

    def _written(self, df: DataFrame, kind: str, batch_id: int) -> str:
        name = f"part/{kind}{batch_id}-{uuid.uuid4().hex[:12]}"
        latest_by_key(df, self.keys, self.order).write.parquet(f"{self.path}/{name}")
        return name

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Adds a micro-batch; one that is repeated counts once."""
        parts = self.listed()
        ids = {p: (m[1], int(m[2])) for p in parts for m in [re.match(r"part/([bs])(\d+)-", p)]}
        if any(kind == "s" and until >= batch_id for kind, until in ids.values()):
            return
        parts = [p for p in parts if ids[p] != ("b", batch_id)] + [self._written(batch, "b", batch_id)]
        if len(parts) > self.parts:
            parts = [self._written(self._read(parts, batch), "s", batch_id)]
        self._publish(parts)

    def _read(self, parts: Sequence[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self, like: DataFrame) -> DataFrame:
        """The newest row of each key in the newest version; ``like`` gives the columns."""
        parts = self.listed()
        return latest_by_key(self._read(parts, like), self.keys, self.order) if parts else self.spark.createDataFrame([], like.schema)
