"""Snapshots: tables below a dated folder, and a small pointer that is written last, so that a failure leaves the live snapshot
as it is.

Tables with a key are written in buckets of its hash, sorted in each, with Bloom filters: tables of the same key join without a
shuffle, and a look-up reads one bucket and in it the parts that can hold the key."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.encode import Encoder
from ..operators.index import all_vectors, new_terms

KEEP = 5
#: The first of these that a table has is what it is looked up or joined by; the others order its rows.
KEYS = ("gram", "text_hash", "entity_id", "facet_ix", "fragment_ix")
LAYOUT = "layout.json"


class SnapshotStore:
    """Snapshots below a path of any file system that Spark reaches.  Keyed tables have as many buckets as given, which should
    make a bucket of the largest table some hundred megabytes on average; row_group is the size of a part that a look-up reads or skips."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8, row_group: int = 8 << 20):
        self.spark, self.path, self.buckets, self.row_group = spark, path.rstrip("/"), buckets, row_group

    def _fs(self, path: str):  # noqa: ANN202
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def read_json(self, name: str) -> dict | None:
        """A small JSON file below the path, or None if there is none."""
        fs, target = self._fs(f"{self.path}/{name}")
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return json.loads(bytes(b & 0xFF for b in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> None:
        """Writes beside the file, then renames over it in one step, so that a reader finds the old or the new one."""
        folder, _, file = name.rpartition("/")
        fs, part = self._fs(f"{self.path}/{folder}/.{file}.part" if folder else f"{self.path}/.{file}.part")
        _, target = self._fs(f"{self.path}/{name}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        self._rename(part, target)

    def _rename(self, part, target) -> None:  # noqa: ANN001
        fs = part.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(part), fs.makeQualified(target), how)  # raises if it fails

    def put_file(self, source: str | os.PathLike, name: str) -> None:
        """Copies a local file to its place below the path: beside it first, then renamed."""
        folder, _, file = name.rpartition("/")
        fs, part = self._fs(f"{self.path}/{folder}/.{file}.part")
        _, target = self._fs(f"{self.path}/{name}")
        fs.copyFromLocalFile(False, True, self._fs(f"file://{os.path.abspath(source)}")[1], part)
        self._rename(part, target)

    def get_file(self, name: str, to: str | os.PathLike) -> None:
        """Copies a file below the path to a local one."""
        fs, target = self._fs(f"{self.path}/{name}")
        fs.copyToLocalFile(False, target, self._fs(f"file://{os.path.abspath(to)}")[1], True)

    def exists(self, name: str) -> bool:
        """Whether there is a file or folder below the path, as models/<id>."""
        fs, target = self._fs(f"{self.path}/{name}")
        return fs.exists(target)

    def source(self, name: str = "facets", path: str | None = None) -> tuple[DataFrame, str]:
        """A table from a path of its own or else from the live snapshot, and a text that says which; FileNotFoundError where
        there is neither."""
        if path is not None:
            fs, target = self._fs(path)
            if not fs.exists(target):
                raise FileNotFoundError(path)
            return self.spark.read.parquet(path), path
        snapshot = (self.current() or {}).get("snapshot")
        if not snapshot:
            raise FileNotFoundError(f"no snapshot below {self.path}")
        if not self.exists(f"snapshots/{snapshot}/{name}"):
            raise FileNotFoundError(f"snapshot {snapshot} has no {name}")
        return self.table(name, snapshot), f"snapshot {snapshot}"

    def promote(self, model: str) -> None:
        """Makes model the one that later snapshots are built with."""
        self.write_json("model.json", {"model": model, "promoted_at": datetime.now(UTC).isoformat()})

    def promoted(self) -> str | None:
        return (self.read_json("model.json") or {}).get("model")

    def current(self) -> dict | None:
        return self.read_json("current.json")

    def _live(self, snapshot: str | None) -> str:
        snapshot = snapshot or (self.current() or {}).get("snapshot")
        if not snapshot:
            raise FileNotFoundError(f"no snapshot below {self.path}")
        return snapshot

    def has(self, name: str, snapshot: str | None = None) -> bool:
        """Whether a snapshot, the live one by default, has a table."""
        return self.exists(f"snapshots/{self._live(snapshot)}/{name}")

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        """A table of a snapshot, the live one by default; one in buckets is read as such."""
        snapshot = self._live(snapshot)
        path = f"{self.path}/snapshots/{snapshot}/{name}"
        layout = (self.read_json(f"snapshots/{snapshot}/{LAYOUT}") or {}).get(name)
        if not layout:
            return self.spark.read.parquet(path)
        # the session's catalogue is told of the files and their buckets; it doesn't own them
        known = _catalogued(path)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({layout['schema']}) USING parquet CLUSTERED BY ({layout['by']}) SORTED BY ({layout['sort']}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(known)

    def write_table(self, df: DataFrame, name: str, snapshot: str) -> dict | None:
        """Writes a table and says how it lies, or None where it has no key."""
        path, keys = f"{self.path}/snapshots/{snapshot}/{name}", [k for k in KEYS if k in df.columns]
        if not keys:
            df.write.mode("overwrite").parquet(path)
            return None
        # a row a key: the shuffle deals rows as the buckets do; where a key can have many rows, a bucket is cut along the further keys,
        # so that no task sorts all rows of a key or a bucket
        bucket = F.pmod(F.hash(keys[0]), F.lit(self.buckets))
        rows, known = df.repartitionByRange(self.buckets, bucket, *keys) if len(keys) > 1 else df.repartition(self.buckets, keys[0]), _catalogued(path)
        self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        sink = rows.write.mode("overwrite").bucketBy(self.buckets, keys[0]).sortBy(*keys).option("path", path).option("parquet.block.size", self.row_group)
        sink.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").option(f"parquet.bloom.filter.expected.ndv#{keys[0]}", "100000").saveAsTable(known)
        self.spark.sql(f"DROP TABLE {known}")
        return {"by": keys[0], "sort": ", ".join(keys), "buckets": self.buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}

    def names(self, folder: str) -> list[str]:
        """What a folder below the path holds, sorted; nothing if it isn't there."""
        fs, target = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def delete(self, name: str) -> None:
        fs, target = self._fs(f"{self.path}/{name}")
        fs.delete(target, True)

    def snapshots(self) -> list[str]:
        return self.names("snapshots")

    def publish(self, tables: Mapping[str, DataFrame], terms: DataFrame, encoder: Encoder, version: str, now: datetime | None = None) -> str | None:
        """Writes tables and vectors as a new snapshot and flips the pointer.  None if model and version are the live ones.

        Vectors are reused from the live snapshot if it has the same model; only new texts are encoded."""
        live = self.current()
        if live and (live["model"], live["version"]) == (encoder.name, version):
            return None
        snapshot = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
        if live and live["model"] == encoder.name:
            known = self.table("vectors", live["snapshot"])
            vectors = all_vectors(terms, known, encoder.encode(new_terms(terms, known)))
        else:
            vectors = encoder.encode(terms)
        layout = {name: self.write_table(df, name, snapshot) for name, df in {**tables, "vectors": vectors}.items()}
        self.write_json(f"snapshots/{snapshot}/{LAYOUT}", layout)
        self.write_json("current.json", {"snapshot": snapshot, "model": encoder.name, "version": version})
        self.prune()
        return snapshot

    def prune(self, keep: int = KEEP) -> None:
        """Deletes all but the newest snapshots; the live one stays."""
        live = (self.current() or {}).get("snapshot")
        for name in self.snapshots()[:-keep]:
            if name != live:
                for table in self.read_json(f"snapshots/{name}/{LAYOUT}") or {}:
                    self.spark.sql(f"DROP TABLE IF EXISTS {_catalogued(f'{self.path}/snapshots/{name}/{table}')}")
                self.delete(f"snapshots/{name}")


def _catalogued(path: str) -> str:
    """The name of a path's table in the session's catalogue."""
    return "fragmill_" + hashlib.sha256(path.encode()).hexdigest()[:24]


class Follower:
    """Serves the live snapshot's tables and moves to a newer one when asked to look."""

    def __init__(self, store: SnapshotStore, names: list[str]):
        self.store, self.names, self.snapshot, self.tables = store, names, None, {}

    def poll(self) -> bool:
        """Moves to the live snapshot if it is another one; the old tables stay until the new ones are ready."""
        live = (self.store.current() or {}).get("snapshot")
        if not live or live == self.snapshot:
            return False
        fresh = {n: self.store.table(n, live).cache() for n in self.names}
        try:
            for df in fresh.values():
                df.count()  # caching is lazy: the new tables are read before the old ones go
        except Exception:
            for df in fresh.values():
                df.unpersist()
            raise
        old, self.tables, self.snapshot = self.tables, fresh, live
        for df in old.values():
            df.unpersist()
        return True
