"""Tables of results: hash buckets of a key, versions by manifest, compaction in tiers.

A table is a folder. Rows are written to a new part, ``parts/part=<name>/bucket=<n>/``, and belong to the
table once a manifest names the part; manifests are numbered, written under another name and
renamed. A reader takes the last manifest, so a writer that stops between rows and manifest
leaves the version before readable, and its part is removed later. Each append is a part of level 0;
``fanout`` parts of a level are merged into one of the next, so a table of n appends has
fewer than ``fanout`` parts on each of log(n) levels, and every row is rewritten once a level. The
number of buckets belongs to the table and is fixed when it is made. One writer at a time; a second
one fails when it finds its number taken.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
FANOUT = 8
KEPT = 4  # manifests which stay readable


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    buckets: int = BUCKETS
    parts: dict[str, int] = field(default_factory=dict)  # level of each part
    batches: dict[str, int] = field(default_factory=dict)  # last batch of each stream


def bucket_of(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


class ResultTable:
    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS, fanout: int = FANOUT
    ):
        if buckets < 1 or fanout < 2:
            raise ValueError("a table has one bucket at least, and two parts at least are merged")
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.buckets, self.fanout = buckets, fanout

    # Files, through Spark's own file systems.

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _remove(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names("_manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the last one by default; an empty one before the first append."""
        found = self.versions()
        if not found and version is None:
            return Manifest(buckets=self.buckets)
        fs, path = self._at(f"_manifests/v{found[-1] if version is None else version}.json")
        stream = fs.open(path)
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, new: Manifest) -> None:
        fs, made = self._at(f"_manifests/.{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(json.dumps(new.__dict__).encode())
        stream.close()
        _, named = self._at(f"_manifests/v{new.version}.json")
        if fs.exists(named) or not fs.rename(made, named):
            fs.delete(made, False)
            raise RuntimeError(f"version {new.version} of {self.path} was written by another writer")

    # Rows.

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version, of some buckets if given."""
        return self._rows(self.manifest(version).parts, buckets).select(*self.schema.names)

    def _rows(self, parts, buckets: list[int] | None = None) -> DataFrame:
        whole = T.StructType([*self.schema, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
        if not parts:
            return self.spark.createDataFrame([], whole)
        root = f"{self.path}/parts"
        rows = self.spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/part={p}" for p in sorted(parts)])
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def dealt(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """Rows with their bucket, each bucket in one task."""
        rows = df.withColumn("bucket", bucket_of(self.key, self.manifest().buckets))
        return rows.repartition("bucket") if tasks is None else rows.repartition(tasks, "bucket")

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None, dealt: bool = False) -> bool:
        """Add rows as one part; one task writes one bucket, so a part has at most a file for each.

        ``batch`` (stream, number) makes an append which is run again add nothing; False is returned
        then. ``dealt`` rows come from ``dealt`` with their bucket and are written where they are.
        """
        now = self.manifest()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return False
        name = uuid.uuid4().hex
        rows = df.select(*self.schema.names, "bucket") if dealt else self.dealt(df.select(*self.schema.names))
        rows.write.partitionBy("bucket").parquet(f"{self.path}/parts/part={name}")
        parts = now.parts | ({name: 0} if any(n.startswith("bucket=") for n in self._names(f"parts/part={name}")) else {})
        batches = now.batches | ({batch[0]: batch[1]} if batch else {})
        self._commit(replace(now, version=now.version + 1, parts=parts, batches=batches))
        self.compact()
        return True

    def compact(self) -> None:
        """Merge the parts of every level which has enough of them; then drop what no kept version names."""
        now = self.manifest()
        level = 0
        while level <= max(now.parts.values(), default=-1):
            full = [p for p, at in now.parts.items() if at == level]
            if len(full) >= self.fanout:
                name = uuid.uuid4().hex
                merged = self._rows(full).drop("part").repartition("bucket")
                merged.write.partitionBy("bucket").parquet(f"{self.path}/parts/part={name}")
                parts = {p: at for p, at in now.parts.items() if p not in full} | {name: level + 1}
                now = replace(now, version=now.version + 1, parts=parts)
                self._commit(now)
            level += 1
        self.vacuum()

    def vacuum(self) -> None:
        """Remove all but the last manifests, and parts which none of those names."""
        found = self.versions()
        for version in found[:-KEPT]:
            self._remove(f"_manifests/v{version}.json")
        used = {p for v in found[-KEPT:] for p in self.manifest(v).parts}
        for name in self._names("parts"):
            if name.removeprefix("part=") not in used:
                self._remove(f"parts/{name}")
