"""A registry of kept results on the driver: least recently used out first, each for a time. It holds plans, not rows."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame


class ResultCache:
    def __init__(self, size: int = 500, ttl: float = 3600.0, clock: Callable[[], float] = time.time) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self.kept: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(query: str, **params: Any) -> str:  # noqa: ANN401
        return hashlib.sha256(json.dumps({"query": query, **params}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]

    def get(self, key: str) -> DataFrame | None:
        self.prune()
        if key not in self.kept:
            self.misses += 1
            return None
        self.hits += 1
        self.kept.move_to_end(key)
        return self.kept[key][1]

    def put(self, key: str, df: DataFrame) -> DataFrame:
        self.drop(key)
        self.kept[key] = (self.clock(), df.persist())
        while len(self.kept) > self.size:
            self.drop(next(iter(self.kept)))
        return df

    def through(self, make: Callable[[], DataFrame], query: str, **params: Any) -> DataFrame:  # noqa: ANN401
        """The kept result of these parameters, or a new one."""
        key = self.key(query, **params)
        found = self.get(key)
        return self.put(key, make()) if found is None else found

    def drop(self, key: str) -> None:
        if key in self.kept:
            self.kept.pop(key)[1].unpersist()

    def prune(self) -> None:
        for key in [k for k, (at, _) in self.kept.items() if self.clock() - at > self.ttl]:
            self.drop(key)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.kept), "hits": self.hits, "misses": self.misses, "hit_rate": round(100 * self.hits / asked, 2) if asked else 0.0}
