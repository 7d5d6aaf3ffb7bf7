"""Layers around handlers: what is counted and traced as rows pass, without a pass of its own."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewheel.functions.flow import counted_as, metrics
from tidewheel.operators.router import Handled, Handler, needs_body
from tidewheel.schemas import body_size


class TraceLayer:
    """Observes the rows a handler is given: how many, their body sizes, depths and statuses.

    ``seen()`` gives them once an action has run over the rows. Observations ride on that action; nothing is read twice.
    """

    def __init__(self, name: str = "trace"):
        self.name = name
        self._all: list[Observation] = []

    def __call__(self, handler: Handler) -> Handler:
        @wraps(handler)
        def traced(rows: DataFrame) -> Handled:
            o = Observation(f"{self.name}-{len(self._all)}")
            self._all.append(o)
            seen = rows.observe(
                o, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(body_size(F.col("body"))), F.lit(0)).alias("body_bytes"), F.max("depth").alias("depth"), F.count_if(F.col("status") >= 400).alias("error_statuses")
            )
            return handler(seen)

        traced.needs_body = needs_body(handler)
        return traced

    def seen(self) -> list[dict]:
        return [o.get for o in self._all]


class MetricLayer:
    """Keeps the outcomes of the handlers it wraps, to be counted when asked."""

    def __init__(self) -> None:
        self._outcomes: list[DataFrame] = []

    def __call__(self, handler: Handler) -> Handler:
        @wraps(handler)
        def counted(rows: DataFrame) -> Handled:
            out = handler(rows)
            if out.flow is not None:
                self._outcomes.append(rows.select(out.flow.alias("flow"), counted_as(out.flow["kind"]).alias("counted_as")))
            return out

        counted.needs_body = needs_body(handler)
        return counted

    def load(self) -> DataFrame | None:
        """One row of counts over all rows so far; None before the first."""
        if not self._outcomes:
            return None
        both = self._outcomes[0]
        for df in self._outcomes[1:]:
            both = both.unionByName(df)
        return metrics(both)
