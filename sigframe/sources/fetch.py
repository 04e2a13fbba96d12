"""Keyed fetching on the executors: a rate per partition, retries with growing pauses, a default on failure."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


class RateLimiter:
    """At most `rate` acquisitions a second, over all threads of a process."""

    def __init__(self, rate: float):
        self.gap, self.free, self.lock = 1 / rate if rate > 0 else 0.0, 0.0, threading.Lock()

    def acquire(self) -> None:
        with self.lock:
            at = max(time.monotonic(), self.free)
            self.free = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def patient(fetch: Callable[[str], str | None], retries: int = 2, pause: float = 1.5, default: str | None = None) -> Callable[[str], str | None]:
    """`fetch` tried again after pauses that grow by `pause`; the default once all tries failed."""

    def run(key: str) -> str | None:
        for k in range(retries + 1):
            try:
                return fetch(key)
            except Exception:  # noqa: BLE001  any failure of one key must not end the others
                if k < retries:
                    time.sleep(pause * (k + 1))
        return default

    return run


def fetch_keys(keys: DataFrame, fetch: Callable[[str], str | None], workers: int = 8, rate: float = 4.0, partitions: int = 1, retries: int = 2, pause: float = 1.5, default: str | None = None) -> DataFrame:
    """key, body for each distinct key (string); `rate` is for all partitions together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(rate / partitions)

        def limited(key: str) -> str | None:
            limiter.acquire()
            return fetch(key)

        one = patient(limited, retries, pause, default)
        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                yield pd.DataFrame({"key": f["key"], "body": list(pool.map(one, f["key"]))})

    return keys.select("key").distinct().repartition(partitions, "key").mapInPandas(run, "key string, body string")
