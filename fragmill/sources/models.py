"""Models in the store: a folder of files each, published whole, probed, downloaded once, and sent to workers, which load it once.

A file is copied beside its place and renamed, and the list of files with sizes and digests is written last: a model that
has no list isn't there."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkFiles

from ..operators.encode import ArrowEncoder
from .snapshot import SnapshotStore

LIST = "files.json"


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Models:
    """Models below models/ of a snapshot store."""

    def __init__(self, store: SnapshotStore):
        self.store = store

    def has(self, model: str) -> bool:
        return self.store.exists(f"models/{model}/{LIST}")

    def upload(self, folder: Path, model: str) -> None:
        """Publishes the files of a local folder; a model that is there stays as it is, which is an error."""
        if self.has(model):
            raise FileExistsError(f"model {model} is there already")
        found = {}
        for path in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
            name = path.relative_to(folder).as_posix()
            self.store.put_file(path, f"models/{model}/{name}")
            found[name] = {"size": path.stat().st_size, "sha256": _digest(path)}
        if not found:
            raise FileNotFoundError(f"{folder} holds no files")
        self.store.write_json(f"models/{model}/{LIST}", found)

    def download(self, model: str, cache: Path) -> Path:
        """The model's files in a local folder; those that are there already aren't fetched again."""
        listed = self.store.read_json(f"models/{model}/{LIST}")
        if listed is None:
            raise FileNotFoundError(f"no model {model}")
        folder = Path(cache) / model
        for name, about in listed.items():
            target = folder / name
            if target.exists() and target.stat().st_size == about["size"]:
                continue
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(target.name + ".part")
            self.store.get_file(f"models/{model}/{name}", part)
            if _digest(part) != about["sha256"]:
                part.unlink()
                raise OSError(f"{model}/{name} didn't arrive whole")
            os.replace(part, target)
        return folder

    def encoder(self, model: str, load: Callable[[str], Callable[[list[str]], list]], batch: int = 64) -> ArrowEncoder:
        """An encoder of that model: Spark sends its folder to the workers, each of which calls load(folder) once."""
        if not self.has(model):
            raise FileNotFoundError(f"no model {model}")
        self.store.spark.sparkContext.addFile(f"{self.store.path}/models/{model}" if "://" in self.store.path else f"file://{self.store.path}/models/{model}", recursive=True)
        return ArrowEncoder(model, lambda: loaded(model, load), batch)


_loaded: dict[str, Callable[[list[str]], list]] = {}


def loaded(model: str, load: Callable[[str], Callable[[list[str]], list]]) -> Callable[[list[str]], list]:
    """The model in a worker, kept from task to task; another one takes its place."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = load(SparkFiles.get(model))
    return _loaded[model]
