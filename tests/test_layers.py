from pyspark.sql import functions as F

from tidewheel.functions import flow
from tidewheel.operators.layers import MetricLayer, TraceLayer
from tidewheel.operators.router import Handled, Router, needs_body
from tidewheel.plans.crawl import Client
from tidewheel.schemas import TAG, tag_str
from tidewheel.sources.backends import NoopBackend


def test_layers_see_what_passes(spark):
    def handler(rows):
        return Handled(rows={"s": rows.select("seq")}, flow=F.when(F.col("seq") == 1, flow.skip()).otherwise(flow.proceed()))

    trace, metric = TraceLayer(), MetricLayer()
    router = Router().route("x", handler).layer(trace).layer(metric)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq bigint, uri string").withColumn("tag", tag_str("x").cast(TAG))
    assert metric.load() is None
    run = Client(spark, router, NoopBackend()).run_once(df)
    assert run.rows["s"].count() == 3
    assert trace.seen()[0]["rows"] == 3
    r = metric.load().first()
    assert (r["total"], r["succeeded"], r["failed"]) == (3, 2, 1)


def test_layers_keep_whether_a_body_is_needed():
    def quiet(rows):
        return Handled()

    quiet.needs_body = False
    assert not needs_body(TraceLayer()(MetricLayer()(quiet)))
