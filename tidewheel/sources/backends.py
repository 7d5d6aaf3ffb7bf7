"""Back ends: what turns requests into responses, as DataFrame -> DataFrame.

A response row is the request with ``status``, ``response_version``, ``response_headers``, ``response_body`` and
``connect_error`` (a message where no connection was made). Any callable of that shape is a back end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewheel.functions import flow
from tidewheel.schemas import HEADERS

RESPONSE_COLUMNS = {"status": "int", "response_version": "string", "response_headers": HEADERS, "response_body": "binary", "connect_error": "string"}


class Backend(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame: ...


def _complete(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({k: (F.col(k) if k in have else F.lit(None)).cast(t) for k, t in RESPONSE_COLUMNS.items()})


@dataclass(frozen=True)
class TableBackend:
    """Fetches by a lookup join on ``uri`` with a table of responses, one per uri. A miss is status 404 with no body.

    Spark chooses the join by the store's size; nothing is broadcast here.
    """

    responses: DataFrame
    miss_status: int = 404

    def __call__(self, requests: DataFrame) -> DataFrame:
        r = self.responses
        have = set(r.columns)
        get = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
        store = r.select(
            F.col("uri"),
            F.coalesce(get("status", "int"), F.lit(200)).alias("status"),
            F.coalesce(get("version", "string"), F.lit("HTTP/1.1")).alias("response_version"),
            get("headers", HEADERS).alias("response_headers"),
            F.coalesce(get("body", "binary"), F.lit(b"")).alias("response_body"),
        )
        found = requests.join(store, "uri", "left")
        found = found.withColumn("status", F.coalesce("status", F.lit(self.miss_status))).withColumn("response_body", F.coalesce("response_body", F.lit(b"")))
        return _complete(found).select(*requests.columns, *RESPONSE_COLUMNS)


@dataclass(frozen=True)
class CallableBackend:
    """Fetches in Python, in Arrow batches.

    ``connect`` makes one client per partition and batch stream; ``resolve(client, request dict)`` gives a dict with
    ``status`` and perhaps ``headers``, ``body``, ``version``. An exception of either is a connection error of the row,
    never of the run. ``concurrency`` caps the number of partitions that fetch at the same time.
    """

    connect: Callable[[], Any]
    resolve: Callable[[Any, dict], dict]
    concurrency: int | None = None
    attempts: int = 3
    backoff_s: float = 0.1

    def __call__(self, requests: DataFrame) -> DataFrame:
        if self.concurrency is not None:
            requests = requests.coalesce(max(1, self.concurrency))
        connect, resolve, attempts, backoff = self.connect, self.resolve, max(1, self.attempts), self.backoff_s

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            client, why = None, None
            for n in range(attempts):
                try:
                    client, why = connect(), None
                    break
                except Exception as e:  # noqa: BLE001
                    why = str(e) or type(e).__name__
                    if n + 1 < attempts:
                        time.sleep(backoff * (n + 1))
            for b in batches:
                rows = []
                for r in b[["seq", "method", "uri", "headers", "body"]].to_dict("records"):
                    out = {"status": None, "response_version": None, "response_headers": None, "response_body": None, "connect_error": why}
                    if why is None:
                        try:
                            a = resolve(client, r)
                            out |= {"status": a.get("status", 200), "response_version": a.get("version", "HTTP/1.1"), "response_headers": a.get("headers"), "response_body": a.get("body", b"")}
                        except Exception as e:  # noqa: BLE001
                            out["connect_error"] = str(e) or type(e).__name__
                    rows.append(out)
                got = pd.DataFrame(rows, columns=list(RESPONSE_COLUMNS))
                yield pd.concat([b.reset_index(drop=True), got], axis=1)

        types = StructType.fromDDL(", ".join(f"{k} {t}" for k, t in RESPONSE_COLUMNS.items()))
        return requests.mapInPandas(work, StructType(requests.schema.fields + types.fields))


@dataclass(frozen=True)
class NoopBackend:
    """Answers every request with an empty 200. As a worker: True continues, False skips, None fetches and continues."""

    value: bool | None = None

    def __call__(self, requests: DataFrame) -> DataFrame:
        return _complete(requests.withColumns({"status": F.lit(200), "response_version": F.lit("HTTP/1.1"), "response_body": F.lit(b"")}))

    def worker(self):
        from tidewheel.operators.router import Handled

        shape = flow.skip() if self.value is False else flow.proceed()

        def work(rows: DataFrame) -> Handled:
            return Handled(flow=shape)

        work.needs_body = self.value is None
        return work


def from_service(service: Callable[[DataFrame], DataFrame]) -> Backend:
    """A back end of any function of requests; missing response columns are null."""
    return lambda requests: _complete(service(requests))


def from_client(client_factory: Callable[[], Any], resolve: Callable[[Any, dict], dict], **options) -> CallableBackend:
    return CallableBackend(client_factory, resolve, **options)


def to_request_rows(requests: DataFrame) -> DataFrame:
    """What goes over the wire; the body is kept."""
    return requests.select("method", "uri", "version", "headers", "body")


def to_response_rows(fetched: DataFrame) -> DataFrame:
    return fetched.select("uri", "method", "status", F.col("response_version").alias("version"), F.col("response_headers").alias("headers"), F.col("response_body").alias("body"))
