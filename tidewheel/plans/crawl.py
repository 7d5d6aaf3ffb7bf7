"""The crawl: drains the frontier level by level until it is empty.

One level is: settle -> fetch (only rows whose handlers need a response) -> written once -> one branch per route ->
rows, children and outcomes. The written level cuts the lineage and lets every branch read the fetch instead of repeating
it. The driver sees one count per level, never rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import flow as flows
from tidewheel.operators import frontier
from tidewheel.operators.datasets import Catalog, Dataset
from tidewheel.operators.router import Router, outcome_rows, parameters
from tidewheel.schemas import OUTCOME_DDL, REQUEST_DDL, schema, tag_key
from tidewheel.sources.backends import RESPONSE_COLUMNS, Backend
from tidewheel.sources.shared import Log, cut, drop


@dataclass
class Run:
    """What a run gives: rows by dataset, every request handled, its outcome, every request that was not handled, and counts.

    ``close`` removes the tables of the run from the shared folder, when its results have been read or written.
    """

    rows: dict[str, DataFrame]
    requests: DataFrame
    outcomes: DataFrame
    left: DataFrame
    levels: int
    total: int
    duration_ms: int
    spark: SparkSession = field(repr=False, default=None)
    folders: list[str] = field(repr=False, default_factory=list)

    def close(self) -> None:
        drop(self.spark, self.folders)

    def deferrals(self) -> DataFrame:
        return flows.fold_deferrals(flows.deferral_rows(self.outcomes))

    def errors(self) -> DataFrame:
        return self.outcomes.where(F.col("is_error"))

    def summary(self) -> DataFrame:
        """One row: total handled, successes and failures, load both ways, levels, time and rate."""
        return flows.metrics(self.outcomes).withColumns({"levels": F.lit(self.levels), "duration_ms": F.lit(self.duration_ms), "per_second": F.lit(self.total * 1000 / max(1, self.duration_ms))})


class Client:
    """A router, a back end, datasets and a queue.

    A crawl goes on until no request is left. On request ``dedup="uri"`` handles each address once, ``max_depth`` holds back
    what is deeper and ``max_levels`` ends the run after so many levels; what they hold back is in ``Run.left``.
    ``on_fail="abort"`` drops requests that a ``Fail`` names from later levels. ``honor_deferral`` waits before a level
    until the first of its deferred tags may go on, at most ``most_wait_s``.
    """

    def __init__(self, spark: SparkSession, router: Router, backend: Backend, *, max_depth: int | None = None, max_levels: int | None = None, dedup: str = "none", order: str = "fifo", on_fail: str = "ignore", honor_deferral: bool = False, most_wait_s: float = 60.0, clock: Callable[[], int] | None = None):
        if dedup not in ("none", "uri") or order not in ("fifo", "lifo") or on_fail not in ("ignore", "abort"):
            raise ValueError("dedup is none or uri, order fifo or lifo, on_fail ignore or abort")
        self.spark, self.router, self.backend = spark, router, backend
        self.max_depth, self.max_levels, self.dedup, self.order, self.on_fail = max_depth, max_levels, dedup, order, on_fail
        self.honor_deferral, self.most_wait_s = honor_deferral, most_wait_s
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.catalog = Catalog(spark)
        self.limit = 8
        self._queue: DataFrame | None = None
        self._initial: DataFrame | None = None
        self._stop = self._now = False
        self._tag = f"crawl-{uuid.uuid4().hex}"

    def with_request_queue(self, requests: DataFrame) -> Client:
        """Replaces the queue."""
        self._queue = frontier.as_requests(requests)
        return self

    def with_initial_requests(self, requests: DataFrame) -> Client:
        requests = frontier.as_requests(requests)
        if self._initial is not None:
            last = self._initial.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
            requests = self._initial.unionByName(requests.withColumn("seq", F.col("seq") + last))
        self._initial = requests
        return self

    def with_dataset(self, name: str, dataset: Dataset) -> Client:
        self.catalog.set(name, dataset)
        return self

    def with_concurrency_limit(self, n: int) -> Client:
        """A cap on the partitions that fetch at a time, at least 1; results do not depend on it."""
        self.limit = max(1, n)
        if hasattr(self.backend, "concurrency"):
            from dataclasses import replace

            self.backend = replace(self.backend, concurrency=self.limit)
        return self

    def dataset(self, name: str, ddl: str) -> Dataset:
        return self.catalog.get(name, ddl)

    def request_queue(self) -> frontier.Queue:
        return frontier.Queue()

    def stop(self, now: bool = False) -> None:
        """No further level is begun. ``now``: the level at work is given up as well; its requests are in ``Run.left``."""
        self._stop = True
        if now:
            self._now = True
            self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def _fetched(self, level: DataFrame) -> DataFrame:
        level = level.withColumn("tag_key", tag_key(F.col("tag")))
        keys, rest = self.router.fetched_keys()
        others = [k for k in self.router.all_keys() if k not in keys]
        needs = F.col("tag_key").isin(*keys) if keys else F.lit(False)
        if rest:
            needs = ~F.col("tag_key").isin(*others) if others else F.lit(True)
        none = {k: F.lit(None).cast(t) for k, t in RESPONSE_COLUMNS.items()}
        if not keys and not rest:
            return level.withColumns(none)
        if rest and not others:
            return self.backend(level).select(*level.columns, *RESPONSE_COLUMNS)
        return self.backend(level.where(needs)).select(*level.columns, *RESPONSE_COLUMNS).unionByName(level.where(~needs).withColumns(none))

    def _level(self, level: DataFrame, now_us: int, folders: list[str]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame | None, DataFrame, int, int]:
        done = cut(self._fetched(level), folders)
        count, top = done.agg(F.count(F.lit(1)), F.coalesce(F.max("seq"), F.lit(0))).first()
        rows: dict[str, list[DataFrame]] = {}
        children, outcomes = [], []
        for _, handler, branch in self.router.branches(done):
            view = branch.withColumn("request_body", F.col("body")).withColumn("body", F.col("response_body"))
            asks = {k: v for k, v in (("client", self.backend), ("level_rows", count)) if k in parameters(handler)}
            got = handler(view.where(F.col("connect_error").isNull()), **asks)
            for name, df in got.rows.items():
                rows.setdefault(name, []).append(df)
            if got.children is not None:
                children.append(got.children)
            outcomes.append(outcome_rows(view, got).drop("connect_error"))
        union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        out = union(outcomes).withColumn("at_us", F.lit(now_us).cast("bigint"))
        return done, {k: union(v) for k, v in rows.items()}, union(children) if children else None, out, count, top

    def _place(self, children: DataFrame, level: DataFrame, level_rows: int, after: int, folders: list[str]) -> DataFrame:
        """Children in queue order: by their parent's place, then by their place among its children."""
        placed = frontier.ordered_by(children.drop("seq"), F.col("parent_seq"), F.col("child_pos"), F.col("uri"), start=after, folders=folders)
        if self.order == "lifo" and placed.isEmpty():
            placed = placed.withColumn("path", F.lit(None).cast("array<bigint>"))
        elif self.order == "lifo":
            paths = frontier.for_join(level.select(F.col("seq").alias("parent_seq"), F.col("path").alias("_up")), level_rows)
            placed = placed.join(paths, "parent_seq", "left").withColumn("path", F.concat(F.coalesce(F.col("_up"), F.array().cast("array<bigint>")), F.array(-F.col("seq")))).drop("_up")
        return placed.drop("parent_tag", "parent_depth", "child_pos")

    def _without_aborted(self, children: DataFrame, outcomes: DataFrame) -> DataFrame:
        asked = flows.aborted_tags(outcomes)
        q = F.col("query")
        keys = (
            F.when((q["kind"] == "Owner") & (F.col("owner")["kind"] != "fallback"), F.array(tag_key(F.col("owner"))))
            .when(q["kind"] == "Single", F.slice(F.transform(q["tags"], tag_key), 1, 1))
            .when(q["kind"] == "List", F.transform(q["tags"], tag_key))
            .when(q["kind"] == "Every", F.array(F.lit("*")))
        )
        gone = asked.select(F.explode(keys).alias("_gone")).distinct()
        if not gone.where(F.col("_gone") == "*").isEmpty():
            return children.limit(0)
        return children.withColumn("_gone", tag_key(F.col("tag"))).join(gone, "_gone", "left_anti").drop("_gone")

    def _start(self) -> DataFrame:
        queued = self._queue
        if self._initial is not None:
            queued = frontier.seed(self._initial, queued)
        queued = frontier.empty(self.spark) if queued is None else queued
        self._queue = self._initial = None
        level = frontier.settle(queued)
        return level.withColumn("path", F.array(-F.col("seq"))) if self.order == "lifo" else level

    def run(self) -> Run:
        sc = self.spark.sparkContext
        sc.addJobTag(self._tag)
        try:
            return self._drain()
        finally:
            sc.removeJobTag(self._tag)

    def _drain(self) -> Run:
        began = time.time()
        level = self._start()
        rows: dict[str, list[DataFrame]] = {}
        requests, outcomes, held, kept = [], [], [], []
        passing: list[str] = []  # folders that only the level at work reads
        visited = Log(self.spark, kept) if self.dedup == "uri" else None
        levels = total = last = 0
        if self.dedup == "uri":
            first = level.groupBy("uri").agg(F.min("seq").alias("seq"))
            level = level.join(first, ["uri", "seq"], "left_semi").select(*level.columns)
        while not self._stop and (self.max_levels is None or levels < self.max_levels):
            now = level
            if self.max_depth is not None:
                now = frontier.within(level, self.max_depth)
                deeper = cut(level.join(now.select("seq"), "seq", "left_anti").select(*level.columns), kept)
                held += [] if deeper.isEmpty() else [deeper]
            try:
                if self.honor_deferral and outcomes:
                    self._wait(now, reduce(DataFrame.unionByName, outcomes))
                done, got, children, out, count, top = self._level(now, self.clock(), kept)
                if not count:
                    level = now.limit(0)
                    break
                read, passing = passing, []
                nxt = None
                if children is not None:
                    if self.on_fail == "abort":
                        children = self._without_aborted(children, out)
                    nxt = frontier.settle(self._place(children, done, count, max(top, last), passing))
                    if self.dedup == "uri":
                        seen = visited.append(done.select("uri"))
                        nxt = cut(frontier.unseen(nxt, seen).select(*nxt.columns), passing)
            except Exception:
                if not self._now:
                    raise
                level = now
                break
            drop(self.spark, read)
            levels, total, last = levels + 1, total + count, max(top, last)
            for k, df in got.items():
                rows.setdefault(k, []).append(df)
            requests.append(done.select(*[f.name for f in schema(REQUEST_DDL)], *(["path"] if self.order == "lifo" else [])))
            outcomes.append(out)
            if nxt is None:
                level = level.limit(0)
                break
            level = nxt
        kept += passing
        union = lambda parts, ddl: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else self.spark.createDataFrame([], schema(ddl))
        made = {k: union(v, "seq bigint") for k, v in rows.items()}
        for k, df in made.items():
            if (ds := self.catalog.try_get(k)) is not None:
                ds.write_batch(df)
        left = union([level, *held], REQUEST_DDL)
        return Run(made, union(requests, REQUEST_DDL), union(outcomes, OUTCOME_DDL), left, levels, total, int((time.time() - began) * 1000), self.spark, kept)

    def run_once(self, requests: DataFrame) -> Run:
        """One level: handles these requests; children stay in ``left``."""
        began = time.time()
        level = frontier.settle(frontier.as_requests(requests))
        if self.order == "lifo":
            level = level.withColumn("path", F.array(-F.col("seq")))
        kept: list[str] = []
        done, rows, children, out, total, last = self._level(level, self.clock(), kept)
        left = frontier.empty(self.spark) if children is None else frontier.settle(self._place(children, done, total, last, kept))
        return Run(rows, done.select(*[f.name for f in schema(REQUEST_DDL)]), out, left, 1, total, int((time.time() - began) * 1000), self.spark, kept)

    def _wait(self, level: DataFrame, outcomes: DataFrame) -> None:
        due = flows.fold_deferrals(flows.deferral_rows(outcomes))
        here = level.select(tag_key(F.col("tag")).alias("tag_key")).distinct().join(due, "tag_key", "left").agg(F.min(F.coalesce(F.col("not_before_us"), F.lit(0)))).first()[0]
        if here:
            time.sleep(max(0.0, min(self.most_wait_s, (here - self.clock()) / 1e6)))
