from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import flow
from tidewheel.operators import frontier
from tidewheel.operators.datasets import Catalog, Dataset
from tidewheel.operators.router import Handled, Router, children_of, constant, needs_body
from tidewheel.plans.crawl import Client
from tidewheel.schemas import TAG, tag_key, tag_str
from tidewheel.sources.backends import CallableBackend, NoopBackend, TableBackend, from_service
from tidewheel.sources.browser import BehaviorConfig, BrowserConfig, ConfigError, PoolConfig


def seeds(spark, *uris):
    return spark.createDataFrame([(i + 1, u) for i, u in enumerate(uris)], "seq bigint, uri string")


def links(spark, pairs):
    edges = spark.createDataFrame(pairs, "src string, dst array<string>")

    def handler(rows):
        found = rows.join(edges, rows["uri"] == edges["src"])
        return Handled(rows={"seen": rows.select("seq", "uri", "depth")}, children=frontier.in_handler().branch(children_of(found, F.col("dst"))))

    handler.needs_body = False
    return handler


def test_urls(spark):
    df = spark.createDataFrame([(1, "https://example.com"), (2, "not a valid url with spaces"), (3, None), (4, "https://"), (5, "/path"), (6, "http://x\n")], "seq bigint, uri string")
    assert [r["seq"] for r in frontier.from_urls(df).orderBy("seq").collect()] == [1, 5]
    assert [r["seq"] for r in frontier.rejected(df).orderBy("seq").collect()] == [2, 3, 4, 6]
    r = frontier.from_urls(df).first()
    assert r["method"] == "GET" and bytes(r["body"]) == b""


def test_run_counts_all_seeds_and_reverses_them(spark):
    c = Client(spark, Router(), NoopBackend()).with_initial_requests(seeds(spark, "a", "b", "c"))
    run = c.run()
    assert run.total == 3 and run.summary().first()["succeeded"] == 3
    assert [r["uri"] for r in run.requests.orderBy("seq").collect()] == ["c", "b", "a"]
    assert c.run().total == 0


def test_breadth_and_depth_first_visit_the_same(spark):
    handler = links(spark, [("r", ["a", "b"]), ("a", ["c"]), ("b", ["d", "e"])])
    runs = {o: Client(spark, Router().fallback(handler), NoopBackend(), order=o).with_request_queue(seeds(spark, "r")).run() for o in ("fifo", "lifo")}
    assert [r["uri"] for r in runs["fifo"].requests.orderBy("seq").collect()] == ["r", "a", "b", "c", "d", "e"]
    assert [r["uri"] for r in runs["lifo"].requests.orderBy("path").collect()] == ["r", "b", "e", "d", "a", "c"]
    assert {r["uri"]: r["depth"] for r in runs["fifo"].rows["seen"].collect()} == {"r": 1, "a": 2, "b": 2, "c": 3, "d": 3, "e": 3}


def test_cycles_end(spark):
    handler = links(spark, [("a", ["b"]), ("b", ["a"])])
    make = lambda **k: Client(spark, Router().fallback(handler), NoopBackend(), **k).with_request_queue(seeds(spark, "a")).run()
    assert make(max_depth=4).total == 4
    assert make(dedup="uri").total == 2
    assert make(max_levels=3).total == 3


def test_run_once_leaves_children(spark):
    run = Client(spark, Router().fallback(links(spark, [("r", ["a", "b"])])), NoopBackend()).run_once(seeds(spark, "r"))
    assert run.total == 1 and [(r["uri"], r["depth"]) for r in run.left.orderBy("seq").collect()] == [("a", 2), ("b", 2)]


def test_routes_and_merge():
    h = constant
    a = Router().route("x", lambda r: None)
    with pytest.raises(ValueError):
        a.route("x", lambda r: None)
    with pytest.raises(ValueError):
        a.merge(Router().route("x", lambda r: None))
    with pytest.raises(ValueError):
        Router().fallback(lambda r: None).route(None, lambda r: None)
    assert a.merge(Router().route(1, lambda r: None)).all_keys() == ["s:x", "r:1"]
    assert h is constant


def test_layers_skip_the_fallback_and_state_does_not(spark):
    seen = []

    def base(rows, state):
        seen.append(state)
        return Handled(flow=flow.proceed())

    def layer(handler):
        return lambda rows: Handled(flow=flow.skip())

    router = Router().route("x", base).fallback(base).layer(layer).with_state("s")
    df = seeds(spark, "a", "b").withColumn("tag", F.when(F.col("seq") == 1, tag_str("x").cast(TAG)))
    run = Client(spark, router, NoopBackend()).run_once(df)
    assert {tag_key_(r): r["flow"]["kind"] for r in run.outcomes.withColumn("k", tag_key(F.col("owner"))).collect()} == {"s:x": "Skip", "fallback": "Continue"}
    assert seen == ["s"]


def tag_key_(r):
    return r["k"]


def test_only_rows_that_need_it_are_fetched(spark):
    fetched = []

    def service(requests):
        fetched.append(requests)
        return requests.withColumn("status", F.lit(200))

    router = Router().route("quiet", constant(flow.proceed())).fallback(lambda rows: Handled(rows={"s": rows.select("seq", "status")}))
    df = seeds(spark, "a", "b").withColumn("tag", F.when(F.col("seq") == 1, tag_str("quiet").cast(TAG)))
    run = Client(spark, router, from_service(service)).run_once(df)
    assert fetched[0].count() == 1 and run.total == 2 and run.rows["s"].count() == 1
    assert not needs_body(constant(flow.skip()))


def test_table_backend(spark):
    store = spark.createDataFrame([("a", bytearray(b"x"), 500)], "uri string, body binary, status int")
    got = {r["uri"]: (r["status"], bytes(r["response_body"])) for r in TableBackend(store)(frontier.as_requests(seeds(spark, "a", "b"))).collect()}
    assert got == {"a": (500, b"x"), "b": (404, b"")}


def test_callable_backend_records_failures(spark):
    def resolve(client, request):
        if request["uri"] == "bad":
            raise OSError("file gone")
        return {"status": 200, "body": client + request["uri"].encode()}

    run = Client(spark, Router().fallback(lambda rows: Handled(rows={"b": rows.select("uri", F.col("body").cast("string").alias("b"))})), CallableBackend(lambda: b"c-", resolve)).with_concurrency_limit(0).run_once(seeds(spark, "ok", "bad"))
    assert [tuple(r) for r in run.rows["b"].collect()] == [("ok", "c-ok")]
    bad = run.errors().collect()
    assert len(bad) == 1 and bad[0]["owner"]["kind"] == "fallback" and bad[0]["flow"]["kind"] == "Hold"
    refused = CallableBackend(lambda: 1 / 0, resolve, attempts=2, backoff_s=0)
    assert Client(spark, Router(), refused).run_once(seeds(spark, "x")).total == 1


def test_noop_worker(spark):
    kinds = []
    for v in (True, False, None):
        run = Client(spark, Router().fallback(NoopBackend(v).worker()), NoopBackend()).run_once(seeds(spark, "a"))
        kinds.append(run.outcomes.first()["flow"]["kind"])
    assert kinds == ["Continue", "Skip", "Continue"]


def test_datasets(spark):
    q = Dataset.of(spark, [(1,), (2,), (3,)], "x int")
    assert [q.read()["x"], [r["x"] for r in q.read_batch(5).collect()], q.read(), q.is_empty()] == [1, [2, 3], None, True]
    s = Dataset.stacked(spark, "x int").write(spark, (1,)).write(spark, (2,))
    assert [s.read()["x"], s.len()] == [2, 1]
    s.write(spark, (3,))
    assert [r["x"] for r in s.read_all().collect()] == [3, 1] and s.is_empty()
    m = Dataset.queue(spark, "x int").map_data(lambda d: d.withColumn("x", F.col("x") + 1), lambda d: d.withColumn("x", F.col("x") * 10))
    assert m.write(spark, (1,)).read()["x"] == 20
    assert Dataset(spark.createDataFrame([(1,)], "seq bigint"), unbounded=True).len() == 0
    wrapped = Dataset.queue(spark, "x int").map_data(lambda d: 1 / 0, lambda d: d).map_err(lambda e: KeyError("mapped"))
    with pytest.raises(KeyError):
        wrapped.write(spark, (1,))


def test_a_stack_keeps_ranges_not_keys(spark):
    s = Dataset.stacked(spark, "x int")
    for n in range(1, 6):
        s.write(spark, (n,))
    assert [r["x"] for r in s.read_batch(2).collect()] == [5, 4] and s._read == [(4, 5)]
    s.write(spark, (6,)).write(spark, (7,))
    assert [r["x"] for r in s.read_batch(1).collect()] == [7] and s._read == [(4, 5), (7, 7)]
    assert [r["x"] for r in s.read_batch(2).collect()] == [6, 3] and s._read == [(3, 7)]
    assert s.len() == 2 and [r["x"] for r in s.read_all().collect()] == [2, 1] and s.read_batch(3).count() == 0
    q = Dataset.queue(spark, "x int")
    assert q.read() is None and q.read_batch(2).count() == 0
    q.write(spark, (1,)).write(spark, (1,))
    assert [r["x"] for r in q.read_batch(1).collect()] == [1] and q.len() == 1


def test_a_split_dataset_streams(spark):
    ds = Dataset.of(spark, [(1,), (2,), (3,)], "x int")
    assert ds.read()["x"] == 1
    sink, stream = ds.into_split()
    got = []
    take = lambda batch, _: got.extend((r["seq"], r["x"]) for r in batch.collect())
    stream.drain(take)
    assert sorted(got) == [(2, 2), (3, 3)] and ds.is_empty() and sink is not stream
    sink.push(spark.createDataFrame([(9,)], "x int"))
    stream.drain(take)
    assert sorted(got) == [(2, 2), (3, 3), (4, 9)] and stream.frame().isStreaming


def test_catalog(spark):
    c = Catalog(spark)
    a = c.get("a", "x int")
    assert c.get("a", "x int") is a and c.try_get("b") is None and len(c) == 1 and not c.is_empty()
    c.set("a", Dataset.queue(spark, "x int")).set("b", Dataset.queue(spark, "y int"))
    assert c.try_get("a") is not a and c.names() == ["a", "b"]


def test_run_writes_datasets(spark):
    c = Client(spark, Router().fallback(links(spark, [("r", ["a"])])), NoopBackend()).with_request_queue(seeds(spark, "r"))
    c.with_dataset("seen", Dataset.queue(spark, "seq bigint, uri string, depth bigint"))
    c.run()
    assert [r["uri"] for r in c.catalog.try_get("seen").read_all().collect()] == ["r", "a"]


def test_stop(spark):
    c = Client(spark, Router(), NoopBackend()).with_request_queue(seeds(spark, "a"))
    c.stop()
    assert c.run().total == 0


def test_empty_queue(spark):
    run = Client(spark, Router(), NoopBackend()).with_request_queue(frontier.empty(spark)).run()
    assert run.total == 0 and run.outcomes.count() == 0 and run.deferrals().count() == 0


@pytest.mark.parametrize("make", [lambda: BrowserConfig("").validate(), lambda: BrowserConfig("localhost:4444").validate(), lambda: BrowserConfig(connect_timeout_s=0).validate(), lambda: BehaviorConfig(max_response_size=0), lambda: BehaviorConfig(user_agent=" "), lambda: BehaviorConfig(element_timeout_s=0), lambda: PoolConfig().build(None), lambda: PoolConfig(max_size=0).with_unmanaged("http://x").build(None), lambda: PoolConfig(min_size=10, max_size=5).with_unmanaged("http://x").build(None), lambda: PoolConfig().with_config(BrowserConfig("x"))])
def test_settings_that_are_refused(make):
    with pytest.raises(ConfigError):
        make()


def test_settings():
    p = PoolConfig().without_config_validation().with_config(BrowserConfig("x")).with_managed("http://y/").with_max_retry_attempts(0)
    assert p.max_retry_attempts == 1 and p.select(3).base_url() == "http://y" and str(p.select(1)) == "Browser(http://y/, managed: true)"


def test_browser_backend(spark):
    pages = spark.createDataFrame([("a", "<p>hé</p>")], "uri string, html string")
    b = PoolConfig().with_unmanaged("http://x").build(pages, BehaviorConfig(extract_html=False, extract_text=True))
    got = {r["uri"]: r for r in b(frontier.as_requests(seeds(spark, "a", "b"))).collect()}
    assert bytes(got["a"]["response_body"]).decode() == "hé" and got["a"]["status"] == 200 and got["b"]["connect_error"] and got["b"]["status"] is None


def chain(spark, n):
    return links(spark, [(f"c{i}", [f"c{i + 1}"]) for i in range(n - 1)])


def test_a_deep_crawl_loses_nothing_and_bounds_hold_back(spark):
    whole = Client(spark, Router().fallback(chain(spark, 34)), NoopBackend()).with_request_queue(seeds(spark, "c0")).run()
    assert whole.total == 34 and whole.left.count() == 0 and whole.requests.agg(F.max("depth")).first()[0] == 34
    folders = list(whole.folders)
    assert all(Path(f.removeprefix("file:")).exists() for f in folders)
    whole.close()
    assert not any(Path(f.removeprefix("file:")).exists() for f in folders)
    for bound in ({"max_depth": 3}, {"max_levels": 3}):
        run = Client(spark, Router().fallback(chain(spark, 6)), NoopBackend(), **bound).with_request_queue(seeds(spark, "c0")).run()
        assert run.total == 3 and [(r["uri"], r["depth"]) for r in run.left.collect()] == [("c3", 4)]


def test_a_bound_holds_back_some_of_a_level(spark):
    deep = seeds(spark, "c0", "c1").withColumn("depth", F.when(F.col("seq") == 2, 9))
    run = Client(spark, Router().fallback(chain(spark, 2)), NoopBackend(), max_depth=2).with_request_queue(deep).run()
    assert run.total == 2 and [(r["uri"], r["depth"]) for r in run.left.collect()] == [("c1", 9)]


def test_a_level_can_be_given_up(spark):
    import threading
    import time

    def resolve(_, request):
        time.sleep(60)
        return {}

    c = Client(spark, Router().fallback(lambda rows: Handled()), CallableBackend(lambda: None, resolve)).with_request_queue(seeds(spark, "a"))
    timer = threading.Timer(5, lambda: c.stop(now=True))
    timer.start()
    began = time.time()
    run = c.run()
    timer.join()
    assert time.time() - began < 50 and run.total == 0 and [r["uri"] for r in run.left.collect()] == ["a"]


def test_places_hold_whatever_the_partitions(spark):
    """Partitions are coalesced by size, and the places' sort alone is smaller than that with the other columns."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = frontier.ordered_by(rows, F.col("k"), name="place").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["k"], r["place"]) for r in got) == [(i, i + 1) for i in range(20_000)]


def test_a_large_level_is_not_broadcast(spark, monkeypatch):
    from tidewheel.plans.queries import _follow
    from tidewheel.sources.shared import cut

    edges = spark.createDataFrame([("b", "x", "c", 1), ("b", "x", "d", 2), ("a", "x", "e", 3)], "uri string, child_tag string, child_uri string, child_pos bigint")
    run = lambda: Client(spark, Router().fallback(_follow(edges)), NoopBackend(), order="lifo").run_once(seeds(spark, "a", "b", "c"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = run().left
    monkeypatch.setattr(frontier, "MERGE_ROWS", 2, raising=False)
    large = run().left
    assert "SortMergeJoin" not in plan(small) and "SortMergeJoin [parent_seq" in plan(large)
    assert [(r["uri"], r["path"]) for r in large.orderBy("seq").collect()] == [(r["uri"], r["path"]) for r in small.orderBy("seq").collect()] == [("e", [-1, -4]), ("c", [-2, -5]), ("d", [-2, -6])]
    level = cut(frontier.settle(frontier.as_requests(seeds(spark, "a"))))
    assert "SortMergeJoin [uri" in plan(_follow(edges)(level, level_rows=3).children) and "SortMergeJoin" not in plan(_follow(edges)(level, level_rows=2).children)
