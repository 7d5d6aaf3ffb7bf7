"""Routing by tag: each route is one branch over the frontier, declared once and planned by Catalyst.

A handler is a function of the rows of its route (requests with response columns, ``body`` meaning the response's) that
gives :class:`Handled`. It may set ``needs_body = False``: its rows are then not fetched. If it takes ``client`` it gets the
back end, if ``level_rows`` the number of requests of the level at work (for ``frontier.for_join``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache, partial

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions import flow as flows
from tidewheel.functions.errors import from_message
from tidewheel.schemas import FLOW, TAG, fallback_tag, key_of, tag_key


@dataclass
class Handled:
    """Rows by dataset, child requests (with ``parent_seq``, ``parent_tag``, ``parent_depth`` of :func:`children_of`), and the flow of each row."""

    rows: dict[str, DataFrame] = field(default_factory=dict)
    children: DataFrame | None = None
    flow: Column | None = None
    is_error: Column | None = None


Handler = Callable[[DataFrame], Handled]
Layer = Callable[[Handler], Handler]


def constant(flow: Column) -> Handler:
    """A handler that gives this flow and needs no response."""

    def handler(_: DataFrame) -> Handled:
        return Handled(flow=flow)

    handler.needs_body = False
    return handler


def needs_body(handler: Handler) -> bool:
    while isinstance(handler, partial):
        handler = handler.func
    return getattr(handler, "needs_body", True)


def children_of(rows: DataFrame, uris: Column) -> DataFrame:
    """One child per item of ``uris`` (an array of strings), in order, with its parent's place, tag and depth."""
    from tidewheel.operators.frontier import valid_uri

    out = rows.select(F.col("seq").alias("parent_seq"), F.col("tag").alias("parent_tag"), F.col("depth").alias("parent_depth"), F.posexplode(uris).alias("child_pos", "uri")).where(valid_uri(F.col("uri")))
    return out.withColumns(
        {"seq": F.lit(None).cast("bigint"), "method": F.lit("GET"), "version": F.lit("HTTP/1.1"), "headers": F.lit(None).cast("map<string,array<string>>"), "body": F.lit(b""), "tag": F.lit(None).cast(rows.schema["tag"].dataType), "depth": F.lit(None).cast("bigint")}
    )


class Router:
    """Routes by tag. ``route(None, h)`` is the same as ``fallback(h)``; without one, unmatched rows continue."""

    def __init__(self) -> None:
        self._routes: dict[str, Handler] = {}
        self._fallback: Handler | None = None

    def route(self, tag: str | int | None, handler: Handler) -> Router:
        if tag is None:
            return self.fallback(handler)
        key = key_of(tag)
        if key in self._routes:
            raise ValueError(f"a route for tag {tag!r} exists")
        self._routes[key] = handler
        return self

    route_service = route

    def fallback(self, handler: Handler) -> Router:
        if self._fallback is not None:
            raise ValueError("a fallback exists")
        self._fallback = handler
        return self

    fallback_service = fallback

    def merge(self, other: Router) -> Router:
        both = self._routes.keys() & other._routes.keys()
        if both:
            raise ValueError(f"both routers have routes for {sorted(both)}")
        if self._fallback is not None and other._fallback is not None:
            raise ValueError("both routers have a fallback")
        self._routes |= other._routes
        self._fallback = self._fallback or other._fallback
        return self

    def layer(self, layer: Layer) -> Router:
        """Wraps the routes there are, not the fallback and none added later."""
        wrapped = {id(h): _wrapped(layer, h) for h in self._routes.values()}
        self._routes = {k: wrapped[id(h)] for k, h in self._routes.items()}
        return self

    def with_state(self, state) -> Router:
        """Handlers that take ``state`` get it, those that take a part of it by name get that; the fallback included."""
        give = lambda h: _with_state(h, state)
        given = {id(h): give(h) for h in self._routes.values()}
        self._routes = {k: given[id(h)] for k, h in self._routes.items()}
        self._fallback = give(self._fallback) if self._fallback else None
        return self

    def branches(self, rows: DataFrame) -> list[tuple[str, Handler, DataFrame]]:
        """(tag keys, handler, its rows) of each handler and of the fallback. Routes with one handler are one branch."""
        keyed = rows if "tag_key" in rows.columns else rows.withColumn("tag_key", tag_key(F.col("tag")))
        by: dict[int, tuple[Handler, list[str]]] = {}
        for k, h in self._routes.items():
            by.setdefault(id(h), (h, []))[1].append(k)
        out = [(",".join(keys), h, keyed.where(F.col("tag_key").isin(*keys))) for h, keys in by.values()]
        rest = keyed.where(~F.col("tag_key").isin(*self._routes)) if self._routes else keyed
        return [*out, ("fallback", self._fallback or constant(flows.proceed()), rest)]

    def fetched_keys(self) -> tuple[list[str], bool]:
        """Tag keys whose handlers need a response, and whether the fallback does."""
        return [k for k, h in self._routes.items() if needs_body(h)], self._fallback is not None and needs_body(self._fallback)

    def all_keys(self) -> list[str]:
        return list(self._routes)


def _wrapped(layer: Layer, handler: Handler) -> Handler:
    out = layer(handler)
    if not hasattr(out, "needs_body"):
        try:
            out.needs_body = needs_body(handler)
        except AttributeError:
            pass
    return out


def parameters(handler: Handler) -> set[str]:
    import inspect

    try:
        return set(inspect.signature(handler).parameters)
    except (TypeError, ValueError):
        return set()


def _with_state(handler: Handler, state) -> Handler:
    """Gives a handler the state, and parts of it to parameters that have their names (keys of a dict, attributes else)."""
    has = (lambda n: n in state) if isinstance(state, dict) else (lambda n: hasattr(state, n))
    part = (lambda n: state[n]) if isinstance(state, dict) else (lambda n: getattr(state, n))
    given = {n: state if n == "state" else part(n) for n in parameters(handler) - {"rows", "client", "level_rows"} if n == "state" or has(n)}
    return partial(handler, **given) if given else handler


@lru_cache(maxsize=4)
def _failure(_jvm: int) -> tuple[Column, Column]:
    """The flow of a failed connection and whom it is laid to; built once a session."""
    return flows.from_error(from_message(F.col("connect_error"))), fallback_tag().cast(TAG)


def outcome_rows(rows: DataFrame, handled: Handled) -> DataFrame:
    """(seq, owner, flow, counted_as, is_error) of each row of a branch; a failed connection holds, on behalf of the fallback."""
    failed = F.col("connect_error").isNotNull()
    at_failure, nobody = _failure(id(SparkContext._jvm))
    flow = F.when(failed, at_failure).otherwise(handled.flow if handled.flow is not None else flows.proceed()).cast(FLOW)
    owner = F.when(failed, nobody).otherwise(F.col("tag"))
    error = failed | (handled.is_error if handled.is_error is not None else F.lit(False))
    out = rows.select("seq", owner.alias("owner"), flow.alias("flow"), F.coalesce(error, F.lit(False)).alias("is_error"), F.col("connect_error"))
    return out.withColumn("counted_as", flows.counted_as(F.col("flow")["kind"]))
