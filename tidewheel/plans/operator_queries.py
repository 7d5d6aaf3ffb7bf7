"""Queries over whole tables for single operators: extractors, datasets, layers, back ends, errors, the pool. Registered
beside the others; their SQL states the expected values by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import errors, extract, flow, select, text
from tidewheel.operators import frontier
from tidewheel.operators.datasets import Dataset
from tidewheel.operators.layers import MetricLayer, TraceLayer
from tidewheel.operators.router import Handled, Router, constant
from tidewheel.plans.crawl import Client
from tidewheel.plans.queries import query
from tidewheel.schemas import TAG, body_of, body_size, tag_key, tag_str, task_label
from tidewheel.sources.backends import CallableBackend, NoopBackend, TableBackend, from_client, from_service, to_request_rows, to_response_rows
from tidewheel.sources.browser import BehaviorConfig, BrowserConfig, ConfigError, PoolConfig
from tidewheel.sources.pool import Pool
from tidewheel.sources.shared import shared_folder
from tidewheel.sources.tables import table

# --- extractors ------------------------------------------------------------------------------------------------------

_BODIES = """CASE event_id % 6 WHEN 0 THEN CAST(props AS BINARY) WHEN 1 THEN CAST('[1, 2]' AS BINARY) WHEN 2 THEN CAST('{"a": ' AS BINARY) WHEN 3 THEN X'7BFF7D' WHEN 4 THEN CAST('' AS BINARY) END"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Responses to events: an object, an array, broken JSON, broken UTF-8, an empty body, none."""
    return table(spark, d, "events").select(F.col("event_id"), F.col("event_type"), F.expr(_BODIES).alias("body"))


@query("""SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN strlen(props) WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 3 ELSE 0 END AS BIGINT) AS n_bytes,
    CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '[1, 2]' WHEN 2 THEN '{"a": ' WHEN 3 THEN NULL ELSE '' END AS text, CASE WHEN event_id % 6 = 3 THEN '[context] failed to parse UTF-8' END AS text_error,
    CASE WHEN event_id % 6 > 1 THEN '[context] failed to parse JSON' END AS json_error, CASE WHEN event_id % 6 > 0 THEN '[context] failed to parse JSON' END AS map_error,
    event_id % 6 = 0 AS has_map, event_id % 6 > 1 AS result_failed FROM events""")
def extract_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, strict text and HTML, any JSON and JSON objects of response bodies; optional and result forms."""
    raw, said, page, value, entries = extract.body(), extract.text(), extract.html(), extract.json_value(), extract.json_map()
    told = lambda e: F.when(e.error.isNotNull(), errors.display(e.error))
    return _bodies(spark, d).select(
        "event_id", body_size(raw.value).alias("n_bytes"), F.coalesce(page.optional().value, said.value).alias("text"), told(said).alias("text_error"), told(value).alias("json_error"),
        told(entries).alias("map_error"), entries.optional().value.isNotNull().alias("has_map"), value.result().value["error"].isNotNull().alias("result_failed"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey WHEN 3 THEN NULL END AS id, CASE WHEN c_custkey % 4 IN (0, 3) THEN c_name END AS name, c_custkey % 4 IN (1, 2) AS rejected FROM customer""")
def extract_typed(spark: SparkSession, d: str) -> DataFrame:
    """JSON bodies as a row type: whole, with a value of another type, no object, and with a field that is absent."""
    body = F.expr("""CASE c_custkey % 4 WHEN 0 THEN '{"id": ' || c_custkey || ', "name": "' || c_name || '"}' WHEN 1 THEN '{"id": "x", "name": "y"}' WHEN 2 THEN '"z"' ELSE '{"name": "' || c_name || '"}' END""")
    rows = table(spark, d, "customer").select(F.col("c_custkey"), body.cast("binary").alias("body"))
    user = extract.json_as("id bigint, name string")
    return rows.select("c_custkey", user.optional().value.alias("u"), user.error.isNotNull().alias("rejected")).select("c_custkey", "u.id", "u.name", "rejected")


@query("""SELECT event_id, CASE WHEN event_id % 6 > 0 THEN 'Hold' END AS kind, CASE WHEN event_id % 6 > 0 THEN 'failure' END AS counted_as, CASE event_id % 6 WHEN 0 THEN NULL WHEN 3 THEN 'failed to parse UTF-8' ELSE 'failed to parse JSON' END AS why,
    CASE WHEN event_id % 2 = 0 THEN 'Fail' ELSE 'Hold' END AS error_kind, CASE WHEN event_id % 2 = 0 THEN 'source' END AS error_message FROM events""")
def rejection_flows(spark: SparkSession, d: str) -> DataFrame:
    """The flow of the first extractor that rejects; errors with a query end its tags, others hold their owner."""
    said, entries = extract.text(), extract.json_map()
    asked = F.when(F.col("event_id") % 2 == 0, flow.query("Owner"))
    of_error = flow.from_error(errors.make_error("worker", F.lit("message"), F.lit("source"), asked))
    got = _bodies(spark, d).select("event_id", extract.rejection_flow(said, entries).alias("flow"), F.coalesce(said.error, entries.error)["message"].alias("why"), of_error.alias("e"))
    return got.select("event_id", F.col("flow.kind").alias("kind"), flow.counted_as(F.col("flow.kind")).alias("counted_as"), "why", F.col("e.kind").alias("error_kind"), flow.error_of(F.col("e"))["message"].alias("error_message"))


@query("""SELECT seq, uri, CASE tag.kind WHEN 'sequence' THEN 's:' || tag.name WHEN 'rehash' THEN 'r:' || tag.id ELSE 'fallback' END AS tag_key, greatest(coalesce(depth, 1), 1) AS depth, method || ' ' || uri AS label FROM crawl_seeds""")
def extract_request(spark: SparkSession, d: str) -> DataFrame:
    """Address, tag and depth of requests; none of them rejects."""
    rows = frontier.as_requests(table(spark, d, "crawl_seeds"))
    return rows.select("seq", extract.uri().value.alias("uri"), tag_key(extract.tag().value).alias("tag_key"), extract.depth().value.alias("depth"), task_label(F.col("method"), F.col("uri")).alias("label"))


@query("""SELECT c_custkey, c_name AS name, c_custkey % 3 <> 0 AS has_phone, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS typed, 'name' AS required, 'phone' AS optional FROM customer""")
def select_fields(spark: SparkSession, d: str) -> DataFrame:
    """Required and optional fields of elements, and rows made from attributes."""
    html = F.concat(F.lit("<div><b class=name>"), "c_name", F.lit("</b>"), F.when(F.col("c_custkey") % 3 != 0, F.lit("<i data-phone='1'>x</i>")).otherwise(""), F.lit("</div>"))
    fields = {"name": select.Field("div > b.name"), "phone": select.Field("i[data-phone]", attr="data-phone", required=False)}
    key = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).otherwise("none")
    made = select.from_attributes(F.create_map(F.lit("id"), key), {"id": select.Field("x", kind="bigint")})
    rows = table(spark, d, "customer").select("c_custkey", html.alias("html"), made["id"].alias("typed"))
    found = rows.select("c_custkey", select.elements(F.col("html"), fields, many=False).alias("e"), "typed")
    one = lambda names: F.lit(",".join(names))
    return found.select("c_custkey", "e.name", F.col("e.phone").isNotNull().alias("has_phone"), "typed", one(select.required_attributes(fields)).alias("required"), one(select.optional_attributes(fields)).alias("optional"))


@query("""WITH p AS (SELECT c_custkey, '<p>' || c_name || '</p>' AS html, c_name AS said FROM customer)
SELECT c_custkey, html AS as_html, said AS as_text, html AS as_neither, substr(html, 1, 10) AS cut, 200 AS status, 'text/html; charset=utf-8' AS kind FROM p""")
def browser_content(spark: SparkSession, d: str) -> DataFrame:
    """What is taken from rendered pages: HTML before text, text, HTML where nothing is asked for, and a limit of bytes."""
    uri = F.concat(F.lit("https://h.test/"), F.col("c_custkey").cast("string"))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), uri.alias("uri"), F.concat(F.lit("<p>"), "c_name", F.lit("</p>")).alias("html"))
    asked = frontier.as_requests(pages.select("seq", "uri"))
    pool = PoolConfig().with_unmanaged("http://127.0.0.1:4444")
    ways = {"as_html": BehaviorConfig(extract_text=True), "as_text": BehaviorConfig(extract_html=False, extract_text=True), "as_neither": BehaviorConfig(extract_html=False), "cut": BehaviorConfig(max_response_size=10)}
    out = None
    for name, way in ways.items():
        got = pool.build(pages.select("uri", "html"), way)(asked).select("seq", F.col("response_body").cast("string").alias(name), "status", F.col("response_headers")["content-type"][0].alias("kind"))
        out = got if out is None else out.join(got.drop("status", "kind"), "seq")
    return out.withColumnRenamed("seq", "c_custkey")


# --- back ends -------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 201 END AS status, CASE WHEN c_custkey % 7 <> 0 THEN 'got e://' || c_custkey END AS body, CASE WHEN c_custkey % 7 = 0 THEN 'Hold' ELSE 'Continue' END AS kind, CASE WHEN c_custkey % 7 = 0 THEN 'fallback' ELSE 's:page' END AS owner, c_custkey % 7 = 0 AS is_error FROM customer""")
def callable_backend(spark: SparkSession, d: str) -> DataFrame:
    """Requests resolved in Python by one client a worker; what fails is laid to the fallback and does not end the run."""

    def resolve(client: bytes, request: dict) -> dict:
        if request["seq"] % 7 == 0:
            raise ConnectionError("refused")
        return {"status": 201, "body": client + request["uri"].encode()}

    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("e://"), F.col("c_custkey").cast("string")).alias("uri"), tag_str("page").cast(TAG).alias("tag"))
    router = Router().route("page", lambda rows: Handled(rows={"pages": rows.select("seq", "status", F.col("body").cast("string").alias("body"))}))
    run = Client(spark, router, from_client(lambda: b"got ", resolve)).with_concurrency_limit(3).run_once(rows)
    told = run.outcomes.select("seq", F.col("flow.kind").alias("kind"), tag_key(F.col("owner")).alias("owner"), "is_error")
    return told.join(run.rows["pages"], "seq", "left").withColumnRenamed("seq", "c_custkey")


@query("SELECT seq, 'POST' AS method, 'HTTP/1.1' AS version, url AS uri, CAST(coalesce(strlen(title), 0) AS BIGINT) AS sent, CAST(coalesce(strlen(title), 0) AS BIGINT) AS received, 200 AS status FROM page_data WHERE url IS NOT NULL")
def service_backend(spark: SparkSession, d: str) -> DataFrame:
    """A function of requests as a back end: it answers with the body that it was sent."""
    rows = table(spark, d, "page_data").where(F.col("url").isNotNull())
    asked = frontier.as_requests(rows.select("seq", F.col("url").alias("uri"), F.lit("POST").alias("method"), body_of(F.col("title")).alias("body")))
    echo = from_service(lambda r: r.withColumns({"status": F.lit(200), "response_body": F.col("body"), "response_version": F.col("version")}))
    got = echo(asked)
    wire, back = to_request_rows(asked).columns, to_response_rows(got).columns
    assert wire == ["method", "uri", "version", "headers", "body"] and back == ["uri", "method", "status", "version", "headers", "body"]
    return got.select("seq", "method", "version", "uri", body_size(F.col("body")).alias("sent"), body_size(F.col("response_body")).alias("received"), "status")


@query("""SELECT c_custkey, 'http://' || CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || ':4444' AS endpoint, strlen('<p>' || c_custkey || '</p>') AS n_bytes FROM customer""")
def driver_backend(spark: SparkSession, d: str) -> DataFrame:
    """Pages fetched by a pool of three endpoints, one of which fails when it is first asked."""

    def make(config: BrowserConfig) -> dict:
        tries[config.url] = tries.get(config.url, 0) + 1
        if config.url == "http://b:4444/" and tries[config.url] == 1:
            raise ConnectionError("not yet")
        return {"at": config.url}

    tries: dict[str, int] = {}
    pool = PoolConfig().with_unmanaged("http://a:4444").with_unmanaged("http://b:4444/").with_managed("http://c:4444").with_sizes(4, 1)
    backend = pool.drive(make, lambda driver, request: {"html": f"<p>{request['seq']}</p>"})
    rows = frontier.as_requests(table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("e://"), F.col("c_custkey").cast("string")).alias("uri")))
    return backend(rows).select(F.col("seq").alias("c_custkey"), F.col("response_headers")["x-endpoint"][0].alias("endpoint"), body_size(F.col("response_body")).alias("n_bytes"))


@query("""SELECT * FROM (VALUES ('created', 5), ('recycled', 4), ('retried', 2), ('size', 1), ('available', 1), ('max_size', 2), ('exhausted', 1), ('backoff_ms', 300)) t(what, n)""")
def pool_status(spark: SparkSession, d: str) -> DataFrame:
    """A pool in numbers: two attempts that fail, one connection too old, one too long idle, one ill, one ended, and one request too many."""
    now, waits, made = [0.0], [], []

    def make(config: BrowserConfig) -> int:
        made.append(config)
        if len(made) < 3:
            raise ConnectionError("not yet")
        return len(made)

    ill: set[int] = set()
    config = PoolConfig().with_unmanaged("http://a").with_sizes(2, 0).with_times(0.0, 10.0, 5.0)
    pool = Pool(config, make, healthy=lambda driver: driver not in ill, clock=lambda: now[0], sleep=waits.append)
    pool.give(c := pool.acquire(0))  # the third attempt
    now[0] += 6
    pool.give(c := pool.acquire(0))  # it was idle too long: another
    for _ in range(3):
        now[0] += 4
        pool.give(c := pool.acquire(0))  # after 12 it is too old: another
    ill.add(c.driver)
    c, other = pool.acquire(0), pool.acquire(0)  # ill: another; and a second one
    try:
        pool.acquire(0)
        refused = 0
    except RuntimeError:
        refused = 1
    pool.give(c)
    pool._end(other)
    s = pool.status()
    got = {"created": s.created, "recycled": s.recycled, "retried": s.retried, "size": s.size, "available": s.available, "max_size": s.max_size, "exhausted": refused, "backoff_ms": round(1000 * sum(waits))}
    return spark.createDataFrame(list(got.items()), "what string, n int")


# --- datasets --------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation)
SELECT 'first' AS step, place, n_name AS name FROM o WHERE place = 1 UNION ALL SELECT 'rest', place, n_name FROM o WHERE place > 1 UNION ALL SELECT 'rest', 26, 'NOWHERE' UNION ALL SELECT 'left before', 25, NULL UNION ALL SELECT 'left after', 0, NULL""")
def dataset_drain(spark: SparkSession, d: str) -> DataFrame:
    """One row read, one more written, the rest drained; how many are left before and after."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("name"))
    ds = Dataset.of(spark, [], "seq bigint, name string").reserved(100).write_batch(nations)
    one = ds.read()
    ds.write(spark, ("NOWHERE",))
    before = ds.len()
    rest = ds.read_all()
    counts = [("first", one["seq"], one["name"]), ("left before", before, None), ("left after", 0 if ds.is_empty() else ds.len(), None)]
    shape = "step string, place bigint, name string"
    return spark.createDataFrame(counts, shape).unionByName(rest.select(F.lit("rest").alias("step"), F.col("seq").alias("place"), "name"))


@query("SELECT o_orderkey AS key, round(o_totalprice * 100) AS stored, 'order ' || o_orderkey AS name FROM orders")
def dataset_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Rows mapped on their way into a dataset and on their way out."""
    ds = Dataset.queue(spark, "key bigint, cents double").map_data(lambda df: df.select("seq", "key", F.round(F.col("price") * 100).alias("cents")), lambda df: df.withColumn("name", F.concat(F.lit("order "), F.col("key").cast("string"))))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    return ds.write_batch(orders).read_all().select("key", F.col("cents").alias("stored"), "name")


@query("SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier UNION ALL SELECT c_custkey, (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey) FROM customer")
def dataset_split(spark: SparkSession, d: str) -> DataFrame:
    """A dataset split into a sink and a stream: what was there, then what is pushed, drained to a table."""
    keys = lambda name, key: table(spark, d, name).select(F.col(key).cast("bigint").alias("seq"), F.col(key).cast("bigint").alias("key"))
    sink, stream = Dataset.queue(spark, "key bigint").boxed().write_batch(keys("supplier", "s_suppkey")).into_split()
    folder = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/n={n}")
    stream.drain(keep)
    sink.push(keys("customer", "c_custkey"))
    stream.drain(keep)
    return spark.read.schema("seq bigint, key bigint, n int").parquet(folder).select("key", F.col("seq").alias("place"))


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus")
def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """A table as a stream into an external sink, twice: the second time there is nothing left to read."""
    from tidewheel.streaming import frontier as streaming

    work = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    orders.write.parquet(f"{work}/in")
    for _ in range(2):
        streaming.to_sink(streaming.stream_of(spark, f"{work}/in", orders.schema), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.schema(orders.schema).parquet(f"{work}/out").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT 'nations' AS name, count(*) AS n FROM nation UNION ALL SELECT 'by region', count(*) FROM nation UNION ALL SELECT 'replaced', 0 UNION ALL SELECT 'created', 0 UNION ALL SELECT 'datasets', 4""")
def catalog_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A run that writes several datasets of a catalogue: registered, replaced and made on request."""

    def handler(rows: DataFrame) -> Handled:
        return Handled(rows={"nations": rows.select("seq", "uri"), "by region": rows.select("seq", F.col("depth"))})

    handler.needs_body = False
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("uri"))
    client = Client(spark, Router().fallback(handler), NoopBackend()).with_request_queue(rows)
    for name, shape in (("nations", "seq bigint, uri string"), ("by region", "seq bigint, depth bigint"), ("replaced", "x int")):
        client.with_dataset(name, Dataset.queue(spark, shape))
    client.catalog.try_get("replaced").write(spark, (1,))
    client.with_dataset("replaced", Dataset.queue(spark, "x int"))
    client.dataset("created", "y int")
    client.run()
    sizes = [(n, client.catalog.try_get(n).len()) for n in client.catalog.names()]
    return spark.createDataFrame([*sizes, ("datasets", len(client.catalog))], "name string, n bigint")


@query("""SELECT seq, CASE tag.kind WHEN 'sequence' THEN 's:' || tag.name WHEN 'rehash' THEN 'r:' || tag.id ELSE 's:default' END AS appended, coalesce(depth, 5) AS append_depth, coalesce(depth, 2) AS branch_depth, 'r:7' AS numbered FROM crawl_seeds""")
def queue_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A queue with a default tag and depth; tags by name and by number."""
    t = F.col("tag")
    seeds = table(spark, d, "crawl_seeds")
    seeds = frontier.as_requests(seeds.withColumn("tag", F.when(t["kind"] != "fallback", t.cast(TAG))))
    q = frontier.Queue().with_default_tag("default").with_default_depth(5)
    a, b, c = q.append(seeds), q.branch(seeds), q.append_with_tag(7, seeds)
    out = a.select("seq", tag_key(F.col("tag")).alias("appended"), F.col("depth").alias("append_depth"))
    return out.join(b.select("seq", F.col("depth").alias("branch_depth")), "seq").join(c.select("seq", tag_key(F.col("tag")).alias("numbered")), "seq")


# --- routes ----------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CASE lower(trim(processing_method)) WHEN 'rendered page' THEN 'rendered' WHEN 'static page' THEN 'static' ELSE 'rest' END AS route FROM page_data), m AS (SELECT count(*) FILTER (route <> 'rest') AS n, count(*) FILTER (route = 'static') AS s FROM r)
SELECT route, CASE route WHEN 'static' THEN 'Skip' ELSE 'Continue' END AS kind, CASE route WHEN 'rest' THEN 'none' ELSE 'state of ' || route END AS note, count(*) AS n FROM r GROUP BY route
UNION ALL SELECT 'traced', 'rendered', NULL, count(*) FILTER (route = 'rendered') FROM r UNION ALL SELECT 'traced', 'static', NULL, s FROM m UNION ALL SELECT 'counted', 'succeeded', NULL, n - s FROM m UNION ALL SELECT 'counted', 'failed', NULL, s FROM m
UNION ALL SELECT 'refused', 'duplicate', NULL, 3""")
def router_layers(spark: SparkSession, d: str) -> DataFrame:
    """Two routers merged, with layers around their routes but not the fallback, and state for all; what clashes is refused."""

    def rendered(rows: DataFrame, state: dict, prefix: str) -> Handled:
        return Handled(rows={"seen": rows.select("seq", F.lit("rendered").alias("route"), F.lit(f"{prefix}{state['rendered']}").alias("note"))}, flow=flow.proceed())

    def static(rows: DataFrame, prefix: str) -> Handled:
        return Handled(rows={"seen": rows.select("seq", F.lit("static").alias("route"), F.lit(f"{prefix}static").alias("note"))}, flow=flow.skip())

    def rest(rows: DataFrame) -> Handled:
        return Handled(rows={"seen": rows.select("seq", F.lit("rest").alias("route"), F.lit("none").alias("note"))})

    trace, metric = TraceLayer(), MetricLayer()
    router = Router().route("rendered page", rendered).merge(Router().route("static page", static).fallback(rest)).with_state({"rendered": "rendered", "prefix": "state of "}).layer(trace).layer(metric)
    refused = 0
    for clash in (lambda: router.route("static page", rest), lambda: router.merge(Router().route("rendered page", rest)), lambda: router.merge(Router().fallback(rest))):
        try:
            clash()
        except ValueError:
            refused += 1
    rows = table(spark, d, "page_data").select("seq", F.col("url").alias("uri"), F.lower(F.trim("processing_method")).alias("m"))
    run = Client(spark, router, NoopBackend()).run_once(rows.withColumn("tag", F.when(F.col("m").isNotNull(), tag_str(F.col("m")).cast(TAG))))
    seen = run.rows["seen"].join(run.outcomes.select("seq", F.col("flow.kind").alias("kind")), "seq").groupBy("route", "kind", "note").agg(F.count(F.lit(1)).alias("n"))
    # an observation is of one action over all rows; its numbers are there once such an action has run
    run.rows["seen"].write.format("noop").mode("overwrite").save()
    m = metric.load().first()
    counts = [("traced", name, o["rows"]) for name, o in zip(("rendered", "static"), trace.seen())] + [("counted", "succeeded", m["succeeded"]), ("counted", "failed", m["failed"]), ("refused", "duplicate", refused)]
    return seen.unionByName(spark.createDataFrame([(a, b, None, n) for a, b, n in counts], "route string, kind string, note string, n bigint"))


@query("SELECT seq, CASE WHEN EXISTS (SELECT 1 FROM page_content c WHERE c.url = d.url) THEN 200 ELSE 404 END AS again FROM page_data d WHERE url IS NOT NULL")
def handler_client(spark: SparkSession, d: str) -> DataFrame:
    """A handler that asks the back end itself, for the rows that it is given."""

    def handler(rows: DataFrame, client) -> Handled:
        asked = client(frontier.as_requests(rows.select("seq", "uri")))
        return Handled(rows={"again": asked.select("seq", F.col("status").alias("again"))})

    handler.needs_body = False
    store = table(spark, d, "page_content").where(F.col("url").isNotNull()).select(F.col("url").alias("uri")).distinct()
    rows = table(spark, d, "page_data").where(F.col("url").isNotNull()).select("seq", F.col("url").alias("uri"))
    return Client(spark, Router().fallback(handler), TableBackend(store)).run_once(rows).rows["again"]


@query("SELECT o_orderkey % 5 = 0 AS worked, CASE WHEN o_orderkey % 5 = 0 THEN 'Continue' ELSE 'Skip' END AS kind, count(*) AS n FROM orders GROUP BY ALL")
def noop_workers(spark: SparkSession, d: str) -> DataFrame:
    """Workers that only continue or skip, and back ends that only answer."""
    on = F.when(F.col("o_orderkey") % 5 == 0, "yes").otherwise("no")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("x").alias("uri"), tag_str(on).cast(TAG).alias("tag"))
    run = Client(spark, Router().route("yes", NoopBackend(True).worker()).route("no", NoopBackend(False).worker()).fallback(constant(flow.proceed())), NoopBackend()).run_once(rows)
    return run.outcomes.groupBy((F.col("owner.name") == "yes").alias("worked"), F.col("flow.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- errors and settings ---------------------------------------------------------------------------------------------

_S = "CAST(n_nationkey AS VARCHAR)"


@query(f"""WITH t AS (SELECT n_nationkey, n_name AS x FROM nation)
SELECT n_nationkey, unnest([
    'connection_failed|http|Failed to connect to WebDriver server at ''' || x || ''': gone', 'webdriver|backend|WebDriver error during ' || x || ': bad', 'webdriver|backend|WebDriver error: bad',
    'invalid_session|backend|Invalid browser session ''' || x || ''': old', 'timeout|timeout|Operation ''' || x || ''' timed out after ' || {_S} || ' seconds', 'pool_exhausted|backend|Browser pool exhausted: ' || {_S} || '/25 connections active',
    'configuration|backend|Configuration error in ''' || x || ''': bad', 'process_error|backend|Process ''' || x || ''' failed with exit code ' || {_S} || ': bad', 'element_error|worker|Element operation ''click'' failed on selector ''' || x || ''': hidden',
    'navigation_error|http|Navigation to ''' || x || ''' failed: HTTP error ' || {_S}, 'navigation_error|http|Navigation to ''unknown'' failed: Network error', 'javascript_error|worker|Script execution failed: bad' || chr(10) || 'Script: ' || x,
    'resource_error|io|Resource error for file ''' || x || ''': full', 'capability_error|backend|Capability ''' || x || ''' error with value ''1'': odd', 'operation_failed|backend|Operation ''' || x || ''' failed: bad',
    'http|http|[http] HTTP error', 'io|io|[io] I/O error', 'own|worker|[worker] ' || x]) AS told FROM t""")
def error_texts(spark: SparkSession, d: str) -> DataFrame:
    """Errors and their texts: those of browsers, of HTTP and I/O, and an error's own."""
    x, n, bad = F.col("n_name"), F.col("n_nationkey"), F.lit("bad")
    browser = [
        ("connection_failed", {"url": x, "source": F.lit("gone")}), ("webdriver", {"context": x, "error": bad}), ("webdriver", {"error": bad}), ("invalid_session", {"session_id": x, "reason": F.lit("old")}), ("timeout", {"operation": x, "duration_secs": n}),
        ("pool_exhausted", {"active_connections": n, "pool_size": F.lit(25)}), ("configuration", {"field": x, "message": bad}), ("process_error", {"operation": x, "exit_code": n, "message": bad}), ("element_error", {"operation": F.lit("click"), "selector": x, "reason": F.lit("hidden")}),
        ("navigation_error", {"url": x, "error_type": errors.navigation_text(F.lit("http"), n)}), ("navigation_error", {"error_type": errors.navigation_text(F.lit("network"))}), ("javascript_error", {"message": bad, "script": x}),
        ("resource_error", {"resource_type": F.lit("file"), "identifier": x, "reason": F.lit("full")}), ("capability_error", {"capability": x, "value": F.lit("1"), "reason": F.lit("odd")}), ("operation_failed", {"operation": x, "message": bad}),
    ]
    told: list[Column] = [F.concat_ws("|", F.lit(name), e["kind"], e["message"]) for name, parts in browser for e in [errors.from_browser(name, **parts)]]
    told += [F.concat_ws("|", F.lit(name), e["kind"], errors.display(e)) for name, e in (("http", errors.http_error()), ("io", errors.io_error()), ("own", errors.make_error("worker", x)))]
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*told)).alias("told"))


@query("""SELECT * FROM (VALUES ('no url', 'backend: WebDriver URL cannot be empty'), ('no scheme', 'backend: Invalid WebDriver URL format: localhost:4444'), ('no connect time', 'backend: Connect timeout must be greater than zero'),
    ('no request time', 'backend: Request timeout must be greater than zero'), ('no navigation time', 'backend: Navigation timeout must be greater than 0'), ('no element time', 'backend: Element timeout must be greater than 0'), ('no size', 'backend: Max response size must be greater than 0'),
    ('blank agent', 'backend: User agent cannot be empty'), ('no endpoint', 'backend: At least one WebDriver configuration is required'), ('no room', 'backend: Pool max_size must be greater than zero'), ('small room', 'backend: Pool min_size cannot be greater than max_size'),
    ('unchecked', 'Browser(x, managed: false)'), ('managed', 'Browser(http://y/, managed: true)'), ('base', 'http://y'), ('third', 'Browser(http://c, managed: false)'), ('fourth', 'Browser(http://a, managed: false)'), ('retries', '1'), ('default', '["http://127.0.0.1:4444"]')) t(name, said)""")
def config_checks(spark: SparkSession, d: str) -> DataFrame:
    """What settings are refused with, and what those that are not come to."""
    three = PoolConfig().with_unmanaged("http://a").with_unmanaged("http://b").with_unmanaged("http://c")
    cases = {
        "no url": lambda: BrowserConfig("").validate(), "no scheme": lambda: PoolConfig().with_configs([BrowserConfig("localhost:4444")]), "no connect time": lambda: BrowserConfig().with_connect_timeout(0).validate(), "no request time": lambda: BrowserConfig(request_timeout_s=0).validate(),
        "no navigation time": lambda: BehaviorConfig(navigation_timeout_s=0), "no element time": lambda: BehaviorConfig(element_timeout_s=0), "no size": lambda: BehaviorConfig(max_response_size=0), "blank agent": lambda: BehaviorConfig(user_agent=" "),
        "no endpoint": lambda: PoolConfig().validate(), "no room": lambda: three.with_sizes(0).validate(), "small room": lambda: three.with_sizes(5, 10).validate(),
        "unchecked": lambda: PoolConfig().without_config_validation().with_config(BrowserConfig("x")).configs[0], "managed": lambda: PoolConfig().with_managed("http://y/").configs[0], "base": lambda: BrowserConfig("http://y/").base_url(),
        "third": lambda: three.select(2), "fourth": lambda: three.select(3), "retries": lambda: three.with_max_retry_attempts(0).max_retry_attempts, "default": lambda: str([c.url for c in PoolConfig().drive(None, None).config.configs]).replace("'", '"'),
    }

    def said(case) -> str:
        try:
            return str(case())
        except ConfigError as e:
            return f"{e.kind}: {e}"

    return spark.createDataFrame([(name, said(case)) for name, case in cases.items()], "name string, said string")
