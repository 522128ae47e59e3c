"""Snapshot cache of source frames, keyed by source and day-aligned bounds."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from concurrent.futures import Future
from datetime import date

from pyspark.sql import DataFrame

from quillboard.functions.dates import Range

Fetcher = Callable[[str, Range | None], DataFrame]
Key = tuple[str, date | None, date | None]


class SnapshotCache:
    """Fetches each (source, days) once, shares fetches under way, and persists what it got.

    A failed fetch is not kept. Invalidation drops entries and makes fetches under way count for their
    waiting callers only.
    """

    def __init__(self, fetcher: Fetcher, persist: bool = True):
        self._fetch, self._persist = fetcher, persist
        self._held: dict[Key, DataFrame] = {}
        self._flying: dict[Key, Future] = {}
        self._lock = threading.Lock()

    @staticmethod
    def key(source_id: str, bound: Range | None) -> Key:
        return (source_id, bound.start.date() if bound else None, bound.end.date() if bound else None)

    def get(self, source_id: str, bound: Range | None = None) -> DataFrame:
        key = self.key(source_id, bound)
        with self._lock:
            if key in self._held:
                return self._held[key]
            flight = self._flying.get(key)
            mine = flight is None
            if mine:
                flight = self._flying[key] = Future()
        if not mine:
            return flight.result()
        try:
            df = self._fetch(source_id, bound)
            df = df.persist() if self._persist else df
        except BaseException as error:
            with self._lock:
                if self._flying.get(key) is flight:
                    del self._flying[key]
            flight.set_exception(error)
            raise
        with self._lock:
            if self._flying.get(key) is flight:
                del self._flying[key]
                self._held[key] = df
        flight.set_result(df)
        return df

    def invalidate(self, source_ids: Iterable[str] | None = None) -> None:
        """Forget the given sources, or all."""
        chosen = None if source_ids is None else set(source_ids)
        with self._lock:
            gone = [k for k in self._held if chosen is None or k[0] in chosen]
            frames = [self._held.pop(k) for k in gone]
            for k in [k for k in self._flying if chosen is None or k[0] in chosen]:
                del self._flying[k]
        if self._persist:
            for df in frames:
                df.unpersist()

    def clear(self) -> None:
        self.invalidate(None)

    def __len__(self) -> int:
        return len(self._held)
