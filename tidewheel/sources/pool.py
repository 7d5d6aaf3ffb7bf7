"""A pool of connections to browsers, one a worker process: made with retries, reused while healthy and young, replaced else.

A driver is whatever ``make(config)`` gives; ``fetch(driver, request)`` answers a request, ``healthy(driver)`` tells whether
it still works and ``close(driver)`` ends it.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from tidewheel.functions.extract import content_bytes
from tidewheel.sources.backends import CallableBackend
from tidewheel.sources.browser import BehaviorConfig, BrowserConfig, PoolConfig

RETRY_WAIT_S = 0.1


class PoolExhausted(RuntimeError):
    pass


@dataclass
class Connection:
    """A driver, its endpoint and what is taken from its pages."""

    driver: Any
    config: BrowserConfig
    behavior: BehaviorConfig
    made: float
    used: float


@dataclass
class Status:
    max_size: int
    size: int
    available: int
    waiting: int
    created: int = 0
    recycled: int = 0
    retried: int = 0


@dataclass
class Pool:
    """At most ``max_size`` connections; the n-th request asks for the endpoint that ``PoolConfig.select(n)`` names."""

    config: PoolConfig
    make: Callable[[BrowserConfig], Any]
    healthy: Callable[[Any], bool] = lambda driver: True
    close: Callable[[Any], None] = lambda driver: None
    behavior: BehaviorConfig = field(default_factory=BehaviorConfig)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        self._idle: dict[int, deque[Connection]] = {}
        self._changed = threading.Condition()
        self._size = self._waiting = self._created = self._recycled = self._retried = 0
        for n in range(self.config.min_size):
            self.give(self.acquire(n))

    def status(self) -> Status:
        with self._changed:
            return Status(self.config.max_size, self._size, sum(map(len, self._idle.values())), self._waiting, self._created, self._recycled, self._retried)

    def _new(self, config: BrowserConfig) -> Connection:
        attempts = max(1, self.config.max_retry_attempts)
        for n in range(1, attempts + 1):
            try:
                driver = self.make(config)
                break
            except Exception:
                if n == attempts:
                    raise
                self._retried += 1
                self.sleep(RETRY_WAIT_S * n)
        self._created += 1
        now = self.clock()
        return Connection(driver, config, self.behavior, now, now)

    def _usable(self, c: Connection) -> bool:
        now, of = self.clock(), self.config
        young = of.max_lifetime_s is None or now - c.made < of.max_lifetime_s
        fresh = of.max_idle_s is None or now - c.used < of.max_idle_s
        return young and fresh and (not of.health_checks or self.healthy(c.driver))

    def _end(self, c: Connection) -> None:
        self._size -= 1
        self._recycled += 1
        self.close(c.driver)

    def acquire(self, seq: int) -> Connection:
        """A connection that works; ``PoolExhausted`` if none comes free within ``acquire_timeout_s``."""
        wanted = self.config.select(seq)
        key = seq % len(self.config.configs)
        until = None if self.config.acquire_timeout_s is None else self.clock() + self.config.acquire_timeout_s
        with self._changed:
            while True:
                idle = self._idle.setdefault(key, deque())
                while idle:
                    if self._usable(c := idle.popleft()):
                        return c
                    self._end(c)
                if self._size >= self.config.max_size and (other := next((q for q in self._idle.values() if q), None)):
                    self._end(other.popleft())  # room for the endpoint asked for
                if self._size < self.config.max_size:
                    self._size += 1
                    break
                left = None if until is None else until - self.clock()
                if left is not None and left <= 0:
                    raise PoolExhausted(f"Browser pool exhausted: {self._size}/{self.config.max_size} connections active")
                self._waiting += 1
                self._changed.wait(left)
                self._waiting -= 1
        try:
            return self._new(wanted)
        except Exception:
            with self._changed:
                self._size -= 1
                self._changed.notify()
            raise

    def give(self, c: Connection) -> None:
        """Puts a connection back; it is looked at when it is next asked for."""
        with self._changed:
            c.used = self.clock()
            self._idle.setdefault(self.config.configs.index(c.config), deque()).append(c)
            self._changed.notify()

    def end(self) -> None:
        with self._changed:
            for q in self._idle.values():
                while q:
                    self._end(q.popleft())


@dataclass(frozen=True)
class DriverBackend:
    """Fetches with a pool of drivers in each worker process; an answer says which endpoint gave it.

    ``fetch(driver, request)`` gives a dict with ``html`` and perhaps ``text``. A page is status 200 and HTML, cut as the
    behaviour says; an exception is a connection error of its row.
    """

    config: PoolConfig
    make: Callable[[BrowserConfig], Any]
    fetch: Callable[[Any, dict], dict]
    healthy: Callable[[Any], bool] = lambda driver: True
    close: Callable[[Any], None] = lambda driver: None
    behavior: BehaviorConfig = field(default_factory=BehaviorConfig)
    concurrency: int | None = None

    def __call__(self, requests: DataFrame) -> DataFrame:
        config, make, fetch, healthy, close, behavior = self.config, self.make, self.fetch, self.healthy, self.close, self.behavior

        def resolve(pool: Pool, request: dict) -> dict:
            c = pool.acquire(int(request["seq"]))
            try:
                page = fetch(c.driver, request)
            finally:
                pool.give(c)
            body = content_bytes(page.get("html") or "", page.get("text"), c.behavior.extract_html, c.behavior.extract_text, c.behavior.max_response_size)
            return {"status": 200, "body": body, "headers": {"content-type": ["text/html; charset=utf-8"], "x-endpoint": [c.config.base_url()]}}

        return CallableBackend(lambda: Pool(config, make, healthy, close, behavior), resolve, self.concurrency, attempts=1)(requests)
