import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidewheel.operators.router import Handled, Router
from tidewheel.plans.crawl import Client
from tidewheel.sources.backends import NoopBackend
from tidewheel.streaming import frontier as streaming


def test_stream_to_sink_goes_on_where_it_ended(spark, tmp_path):
    source, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.createDataFrame([(1,), (2,)], "x int").write.parquet(source)
    run = lambda: streaming.to_sink(streaming.stream_of(spark, source, "x int"), sink, check).awaitTermination()
    run()
    spark.createDataFrame([(3,)], "x int").write.mode("append").parquet(source)
    run()
    assert sorted(r["x"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_crawl_of_a_stream(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    spark.createDataFrame([(1, "a"), (2, "b")], "seq bigint, uri string").write.parquet(source)
    seen = []
    router = Router().fallback(lambda rows: Handled(rows={"u": rows.select("seq", "uri")}))
    streaming.crawl_stream(streaming.stream_of(spark, source, "seq bigint, uri string"), lambda s: Client(s, router, NoopBackend()), lambda run, n: seen.extend(r["uri"] for r in run.rows["u"].collect()), check).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def brute(rows):
    until = None
    for _, _, now, d in rows:
        until = now + d if until is None else max(until, now) + d
    return until


@pytest.mark.parametrize("per_batch", [1, None])
def test_deferral_over_many_files(spark, tmp_path, per_batch):
    source, state, types = str(tmp_path / "in"), str(tmp_path / "state"), "seq bigint, tag_key string, now_us bigint, d_us bigint"
    rows = [(i, "hot", 100 + 7 * i % 13, 5) for i in range(70)]
    files = 7 if per_batch else 70
    given = rows if per_batch else rows[::-1]  # one batch is put in order whatever the order of its files
    for i in range(files):
        part = given[i * 70 // files : (i + 1) * 70 // files]
        pq.write_table(pa.Table.from_pylist([dict(zip(("seq", "tag_key", "now_us", "d_us"), r)) for r in part]), _made(tmp_path / "in") / f"{i:03}.parquet")
        os.utime(tmp_path / "in" / f"{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    q = streaming.deferral_stream(streaming.stream_of(spark, source, types, per_batch), state, str(tmp_path / "c"))
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    assert last == (files - 1 if per_batch else 0)
    assert [tuple(r) for r in streaming.deferral_state(spark, state, last).collect()] == [("hot", brute(rows))]


def _made(folder):
    folder.mkdir(exist_ok=True)
    return folder


def test_counters(spark):
    df = spark.createDataFrame([("a", "success"), ("a", "failure"), ("a", "success")], "tag_key string, counted_as string")
    assert tuple(streaming.counters_stream(df).first()) == ("a", 2, 1)
