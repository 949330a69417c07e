"""A table that a stream appends to exactly once: a folder for each batch, and a manifest for it that is written last.

Readers take the folders that have a manifest, so a batch that was cut off is invisible; when it is run again it writes over
its own folder, and one that was finished is left as it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..sources.snapshot import SnapshotStore


class BatchLog:
    """Batches below a path: data/<batch> and manifests/<batch>.json.  schema is that of the rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.store = spark, path.rstrip("/"), schema, SnapshotStore(spark, path)

    def manifests(self) -> dict[str, dict]:
        """The manifests of the batches that count: not those that a compacted one replaces."""
        found = {n.removesuffix(".json"): self.store.read_json(f"manifests/{n}") or {} for n in self.store.names("manifests") if n.endswith(".json")}
        gone = {b for m in found.values() for b in m.get("replaces", ())}
        return {b: m for b, m in sorted(found.items()) if b not in gone}

    def read(self, **having: str) -> DataFrame:
        """The rows of all finished batches, of those whose manifest has the given values."""
        names = [b for b, m in self.manifests().items() if all(m.get(k) == v for k, v in having.items())]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{b}" for b in names))

    def done(self, batch: str) -> int | None:
        """The rows of a finished batch, also of one that was compacted since, or None."""
        manifest = self.store.read_json(f"manifests/{batch}.json")
        return None if manifest is None else manifest["rows"]

    def append(self, batch: str, df: DataFrame, **about: str) -> int:
        """Writes a batch if it isn't there, and gives its rows, counted as they are written."""
        rows = self.done(batch)
        if rows is None:
            counted = Observation(f"rows-{uuid.uuid4().hex[:8]}")
            df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/data/{batch}")
            rows = counted.get["n"]
            self.store.write_json(f"manifests/{batch}.json", {"rows": rows, **about})
        return rows

    def compact(self, files: int = 8, **having: str) -> str | None:
        """Puts the batches whose manifest has the given values into one folder; the old ones go when its manifest is there."""
        old = {b: m for b, m in self.manifests().items() if all(m.get(k) == v for k, v in having.items())}
        if len(old) < 2:
            return None
        name = f"compact-{uuid.uuid4().hex[:12]}"
        self.read(**having).coalesce(files).write.parquet(f"{self.path}/data/{name}")
        self.store.write_json(f"manifests/{name}.json", {"rows": sum(m["rows"] for m in old.values()), "replaces": sorted(old), **having})
        for batch in old:
            self.store.delete(f"data/{batch}")
        return name
