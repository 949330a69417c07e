"""A server's engine that follows the live snapshot: a thread polls the pointer, builds the next engine aside and swaps it in."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame

from ..sources.snapshot import SnapshotStore
from .encode import Encoder
from .serve import Engine

log = logging.getLogger(__name__)


class Server:
    """engine is always one whole engine: a request that takes it once sees one snapshot.  encoder_of loads the encoder of a model
    name, which happens only when the model changes."""

    def __init__(self, store: SnapshotStore, encoder_of: Callable[[str], Encoder], keywords: Iterable[str] = (), templates: Mapping[str, str] | None = None, seconds: float = 60.0):
        self.store, self.encoder_of, self.keywords, self.templates, self.seconds = store, encoder_of, keywords, templates, seconds
        self.engine: Engine | None = None
        self.snapshot: str | None = None
        self.failures = 0
        self._model, self._encoder, self._held = None, None, []
        self._stop, self._thread = threading.Event(), None
        if not self.poll():  # a server without a snapshot doesn't start
            raise FileNotFoundError(f"no snapshot below {store.path}")

    def _load(self, pointer: dict) -> None:
        encoder = self._encoder if pointer["model"] == self._model else self.encoder_of(pointer["model"])
        held: list[DataFrame] = []

        def kept(df: DataFrame) -> DataFrame:
            held.append(df.cache())
            return held[-1]

        try:
            engine = Engine.of_snapshot(self.store, encoder, self.keywords, self.templates, pointer["snapshot"], kept)
            for df in held:
                df.count()  # caching is lazy: every table is read before the old engine goes
        except Exception:
            for df in held:
                df.unpersist()
            raise
        old, self._held = self._held, held
        self._model, self._encoder, self.snapshot = pointer["model"], encoder, pointer["snapshot"]
        self.engine = engine  # one assignment: a request sees the old engine or the new one
        for df in old:
            df.unpersist()  # a request on the old engine still reads its files

    def poll(self) -> bool:
        """Moves to the live snapshot if it is another one."""
        pointer = self.store.current()
        if not pointer or pointer["snapshot"] == self.snapshot:
            return False
        self._load(pointer)
        return True

    def _follow(self) -> None:
        while not self._stop.wait(self.seconds):
            try:
                if self.poll():
                    log.info("snapshot %s with model %s", self.snapshot, self._model)
            except Exception:  # noqa: BLE001  the present engine goes on serving, and the next poll tries again
                self.failures += 1
                log.exception("poll failed, snapshot %s stays", self.snapshot)

    def start(self) -> Server:
        self._thread = threading.Thread(target=self._follow, name="fragmill-follow", daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
