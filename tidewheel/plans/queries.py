"""Queries of the crawl engine over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import errors, extract, flow, json, select, text
from tidewheel.functions.text import WHITE
from tidewheel.operators import frontier
from tidewheel.operators.datasets import Dataset
from tidewheel.operators.router import Handled, Router, children_of, constant
from tidewheel.plans.crawl import Client
from tidewheel.schemas import FLOW, TAG, as_tag, fallback_tag, tag_key, tag_str
from tidewheel.sources.backends import NoopBackend, TableBackend
from tidewheel.sources.browser import PoolConfig
from tidewheel.sources.shared import shared_folder
from tidewheel.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- texts -----------------------------------------------------------------------------------------------------------

_LINES = "CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT)"
_WORDS = f"CAST(len(regexp_extract_all(text, '[^{WHITE}]+')) AS BIGINT)"
_KIND = f"CASE WHEN regexp_matches(text, '^[{WHITE}]*[{{\\[]') THEN 'JSON-like text' WHEN contains(text, 'html') OR contains(text, 'HTML') THEN 'HTML-like text' WHEN text IS NOT NULL THEN 'Plain text' END"


@query(f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, {_LINES} AS n_lines, {_WORDS} AS n_words, CAST(length(text) AS BIGINT) AS n_characters, contains(lower(text), 'user-agent') AS robots FROM documents")
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.byte_length(t).alias("n_bytes"), text.line_count(t).alias("n_lines"), text.word_count(t).alias("n_words"), text.char_count(t).alias("n_characters"), text.is_robots(t).alias("robots")
    )


@query(f"SELECT doc_id, concat_ws('; ', 'Lines: ' || {_LINES}, 'Words: ' || {_WORDS}, 'Characters: ' || length(text), CASE WHEN contains(lower(text), 'user-agent') THEN 'Type: robots.txt' END) AS metadata FROM documents WHERE text IS NOT NULL")
def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(text.text_metadata(F.col("text")), "; ").alias("metadata"))


@query(f"""WITH bodies AS (
    SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'events', event_id, props FROM events UNION ALL SELECT 'page_content', seq, title FROM page_content
) SELECT source, id, {_KIND} AS content_kind FROM bodies""")
def content_sniff(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, n).select(F.lit(n).alias("source"), F.col(k).alias("id"), F.col(c).alias("text")) for n, k, c in (("documents", "doc_id", "text"), ("events", "event_id", "props"), ("page_content", "seq", "title"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source", "id", text.content_kind(F.col("text")).alias("content_kind"))


@query(f"SELECT doc_id, {_KIND} || ': doc://' || doc_id || ' (' || strlen(text) || ' bytes, ' || {_LINES} || ' lines)' AS summary FROM documents")
def text_summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.text_summary(F.col("text"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string"))).alias("summary"))


@query("""WITH c AS (SELECT doc_id, text, unnest([TRY(decode(array_slice(encode(text), 1, 1000 - k))) FOR k IN [0, 1, 2, 3]]) AS part FROM documents WHERE strlen(text) > 1000),
long AS (SELECT doc_id, part FROM c WHERE part IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strlen(part) DESC) = 1)
SELECT doc_id, CAST(strlen(part) AS BIGINT) AS n_bytes, md5(part) AS digest FROM long UNION ALL SELECT doc_id, strlen(text), md5(text) FROM documents WHERE strlen(text) <= 1000 OR text IS NULL""")
def content_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut_ = text.truncate_bytes(F.col("text"), 1000)
    return table(spark, d, "documents").select("doc_id", cut_.alias("t")).select("doc_id", text.byte_length(F.col("t")).alias("n_bytes"), F.md5("t").alias("digest"))


@query("SELECT 'doc://' || doc_id AS url, 'text/html' AS content_type, CAST(strlen(text) AS BIGINT) AS content_length, 'Sample Page' AS title FROM documents WHERE text IS NOT NULL")
def page_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows a page handler writes."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select(F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.lit("text/html").alias("content_type"), text.byte_length(F.col("text")).alias("content_length"), F.lit("Sample Page").alias("title"))


# --- JSON ------------------------------------------------------------------------------------------------------------

_JSON = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '[' || CAST(event_id AS STRING) || ', "' || event_type || '"]' WHEN 2 THEN '"' || event_type || ' of some length beyond fifty characters in all"' WHEN 3 THEN CAST(event_id AS STRING) ELSE 'null' END"""
_JSON_SQL = _JSON.replace("STRING", "VARCHAR")
_JTYPE = "CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


@query(f"""WITH b AS (SELECT event_id, {_JSON_SQL} AS j FROM events), k AS (SELECT event_id, j, {_JTYPE} AS kind FROM b)
SELECT event_id, kind, CAST(CASE kind WHEN 'object' THEN len(json_keys(j)) WHEN 'array' THEN json_array_length(j) ELSE 1 END AS BIGINT) AS n_fields, CAST(strlen(CAST(json(j) AS VARCHAR)) AS BIGINT) AS n_bytes,
    CASE kind WHEN 'string' THEN '"' || left(json_extract_string(j, '$'), 50) || '"' WHEN 'number' THEN j WHEN 'array' THEN 'Array[' || json_array_length(j) || ']' WHEN 'object' THEN 'Object{{' || len(json_keys(j)) || '}}' ELSE 'null' END AS summary,
    CASE WHEN kind = 'object' THEN array_to_string(list_sort(json_keys(j))[1:10], ',') END AS first_keys FROM k""")
def json_values(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").select("event_id", F.expr(_JSON).alias("j"))
    j = F.col("j")
    return b.select(
        "event_id", json.kind(j).alias("kind"), json.field_count(j).alias("n_fields"), json.compact_size(j).alias("n_bytes"), json.value_summary(j).alias("summary"), F.array_join(json.first_entries(j, 10), ",").alias("first_keys")
    )


_USER = """CASE c_custkey % 6 WHEN 0 THEN '{"slideshow": {"title": "' || c_name || '", "author": "Ann ' || c_mktsegment || '"}}' WHEN 1 THEN '{"slideshow": 1}' WHEN 2 THEN '{"uuid": "' || md5(c_name) || '"}' WHEN 3 THEN '{"zeta": 1, "alpha": "' || c_name || '"}' WHEN 4 THEN '"' || c_name || '"' ELSE '[1]' END"""
_ID = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 100000 + 1)"


@query(f"""WITH b AS (SELECT c_custkey, c_name AS n, c_mktsegment AS m, c_custkey % 6 AS r FROM customer)
SELECT c_custkey, CASE r WHEN 0 THEN {_ID.format("n")} WHEN 1 THEN 1 WHEN 2 THEN {_ID.format("md5(n)")} WHEN 3 THEN {_ID.format("'alpha'")} WHEN 4 THEN {_ID.format("n")} ELSE {_ID.format("'c://' || c_custkey")} END AS id,
    CASE r WHEN 0 THEN n || ' (Ann ' || m || ')' WHEN 1 THEN 'API Data' WHEN 2 THEN 'UUID User ' || substr(md5(n), 1, 8) WHEN 3 THEN 'API Object User (alpha)' WHEN 4 THEN 'String User ' || substr(n, 1, 8) ELSE 'Generic API User' END AS name,
    CASE r WHEN 0 THEN 'ann.' || replace(lower(m), ' ', '.') || '@api.example.com' WHEN 1 THEN 'api@example.com' WHEN 2 THEN 'uuid-' || substr(md5(n), 1, 8) || '@api.example.com' WHEN 3 THEN 'alpha@api.example.com' WHEN 4 THEN 'string@api.example.com' ELSE 'generic@api.example.com' END AS email FROM b""")
def structured_users(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "customer").select("c_custkey", F.expr(_USER).alias("j"), F.concat(F.lit("c://"), F.col("c_custkey").cast("string")).alias("url"))
    return b.select("c_custkey", json.user_fields(F.col("j"), F.col("url")).alias("u")).select("c_custkey", "u.*")


@query("""WITH b AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events WHERE event_id % 3 <> 2)
SELECT event_id, 'Discovered API endpoint: e://' || event_id || ' with ' || (n + 1) || ' fields' AS message FROM b
UNION ALL SELECT event_id, 'Discovered ' || n || ' additional endpoints from e://' || event_id FROM b
UNION ALL SELECT event_id, 'Discovered API endpoint: e://' || event_id || ' with 1 fields' FROM events WHERE event_id % 3 = 2""")
def discovery_messages(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("e://"), F.col("event_id").cast("string"))
    one, two = '\'{"x": 1, "a": "http://h/1"}\'', '\'{"b": "https://h/2", "a": "http://h/1", "y": "ftp://h/3"}\''
    j = F.expr(f"CASE WHEN event_id % 3 = 2 THEN '{{\"y\": 2}}' WHEN event_id % 2 = 0 THEN {one} ELSE {two} END")
    return table(spark, d, "events").select("event_id", F.explode(json.discovery_rows(j, url)).alias("message"))


# --- HTML ------------------------------------------------------------------------------------------------------------

_SQUEEZE = rf"trim(regexp_replace(title, '[{WHITE}\x1c-\x1f]+', ' ', 'g'), ' ')"


@query(f"SELECT seq, {_SQUEEZE} AS heading, '/p/' || seq AS href FROM page_content WHERE title IS NOT NULL")
def page_elements(spark: SparkSession, d: str) -> DataFrame:
    """Headings and links of pages, by selector."""
    safe = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>x</title></head><body><div id=main><h1 class='big title'>"), safe, F.lit("</h1><p>one<p>two</div><a href='/p/"), F.col("seq").cast("string"), F.lit("'>next</a><script>var t='<h1 class=title>';</script></body></html>"))
    pages = table(spark, d, "page_content").where(F.col("title").isNotNull()).select("seq", html.alias("html"))
    found = select.elements(F.col("html"), {"heading": select.Field("#main > h1.title"), "href": select.Field("body a[href]", attr="href")}, many=False)
    return pages.select("seq", found.alias("e")).select("seq", "e.heading", "e.href")


@query("""SELECT url, CAST(content_length AS BIGINT) AS content_length, title, 'rendered page' AS processing_method FROM (
    SELECT 'https://h.test/' || c_custkey AS url, c_name AS title, strlen('<html><head><title>' || c_name || '</title></head><body>' || c_mktsegment || '</body></html>') AS content_length FROM customer)""")
def browser_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows a browser handler writes, from rendered pages: title and source length by their view."""
    url, html = F.concat(F.lit("https://h.test/"), F.col("c_custkey").cast("string")), F.concat(F.lit("<html><head><title>"), "c_name", F.lit("</title></head><body>"), "c_mktsegment", F.lit("</body></html>"))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), url.alias("uri"), html.alias("html"))

    def handler(rows: DataFrame) -> Handled:
        v = select.view(extract.html().value, F.col("uri"))
        return Handled(rows={"browser": rows.select(v.alias("v")).select(F.col("v.current_url").alias("url"), text.byte_length(F.col("v.source")).alias("content_length"), F.col("v.title").alias("title"), F.lit("rendered page").alias("processing_method"))})

    backend = PoolConfig().with_unmanaged("http://127.0.0.1:4444").build(pages.select("uri", "html"))
    return Client(spark, Router().fallback(handler), backend).run_once(pages.select("seq", "uri")).rows["browser"]


# --- frontier --------------------------------------------------------------------------------------------------------


@query("SELECT seq AS given, row_number() OVER (ORDER BY seq DESC) AS seq, uri FROM crawl_seeds")
def seed_order(spark: SparkSession, d: str) -> DataFrame:
    """Initial requests are queued in reverse."""
    seeds = table(spark, d, "crawl_seeds")
    queued = frontier.seed(frontier.as_requests(seeds.withColumn("headers", F.lit(None).cast("map<string,array<string>>"))))
    return queued.join(seeds.select("uri", F.col("seq").alias("given")), "uri").select("given", "seq", "uri")


@query("""WITH r AS (SELECT 'fifo' AS kind, row_number() OVER (ORDER BY n_nationkey) AS place, n_name FROM nation UNION ALL SELECT 'lifo', row_number() OVER (ORDER BY n_nationkey DESC), n_name FROM nation)
SELECT kind, CAST(place AS BIGINT) AS place, n_name AS name FROM r WHERE place <= 7""")
def dataset_reads(spark: SparkSession, d: str) -> DataFrame:
    """The first reads of a queue and of a stack, in batches of 3 and 4."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("name"))
    out = None
    for kind, stack in (("fifo", False), ("lifo", True)):
        ds = Dataset(spark.createDataFrame([], "seq bigint, name string"), stack=stack).write_batch(rows)
        got, at = [], 0
        for n in (3, 4):
            got += [(kind, at + i + 1, r["name"]) for i, r in enumerate(ds.read_batch(n).collect())]
            at += n
        part = spark.createDataFrame(got, "kind string, place bigint, name string")
        out = part if out is None else out.unionByName(part)
    return out


_TAG_SQL = "CASE tag.kind WHEN 'sequence' THEN 's:' || tag.name WHEN 'rehash' THEN 'r:' || tag.id END"


@query(f"""WITH b AS (SELECT seq, {_TAG_SQL} AS t, CASE WHEN depth IS NULL THEN NULL ELSE depth + seq % 3 END AS p FROM crawl_seeds)
SELECT seq, 'append' AS method, coalesce(t, 's:parent') AS tag_key, coalesce(p, 3) AS depth FROM b
UNION ALL SELECT seq, 'branch', coalesce(t, 's:parent'), coalesce(p, 4) FROM b
UNION ALL SELECT seq, 'append_with_tag', 's:own', coalesce(p, 3) FROM b
UNION ALL SELECT seq, 'branch_with_tag', 's:own', 4 FROM b
UNION ALL SELECT seq, 'external_append', coalesce(t, 'fallback'), coalesce(p, 1) FROM b
UNION ALL SELECT seq, 'external_branch', coalesce(t, 'fallback'), coalesce(p, 2) FROM b""")
def queue_rules(spark: SparkSession, d: str) -> DataFrame:
    """What each way to queue does to tag and depth; seeds of the fallback kind stand for requests without a tag."""
    t = F.col("tag")
    seeds = table(spark, d, "crawl_seeds").withColumn("tag", F.when(t["kind"] != "fallback", t.cast(TAG))).withColumn("depth", F.when(F.col("depth").isNotNull(), F.col("depth") + F.col("seq") % 3))
    seeds = frontier.as_requests(seeds).withColumn("parent_tag", as_tag("parent").cast(TAG)).withColumn("parent_depth", F.lit(3))
    inside, outside = frontier.in_handler(), frontier.Queue()
    made = {
        "append": inside.append(seeds), "branch": inside.branch(seeds), "append_with_tag": inside.append_with_tag("own", seeds), "branch_with_tag": inside.branch_with_tag("own", seeds),
        "external_append": outside.append(seeds), "external_branch": outside.branch(seeds),
    }
    out = None
    for name, df in made.items():
        part = frontier.settle(df).select("seq", F.lit(name).alias("method"), tag_key(F.col("tag")).alias("tag_key"), "depth")
        out = part if out is None else out.unionByName(part)
    return out


# written by hand: no white space, controls or signs that an address must escape
_VALID = r"^[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00-\x1f<>\"\\\\^`{|}]+$"


@query(rf"""SELECT seq, url AS uri, 'GET' AS method FROM page_data WHERE regexp_matches(url, '{_VALID}') AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[/?#]|\z)')""")
def request_source(spark: SparkSession, d: str) -> DataFrame:
    """Requests made from addresses; invalid ones are rejected."""
    return frontier.from_urls(table(spark, d, "page_data").select("seq", "url"), "url").select("seq", "uri", "method")


@query("""WITH first AS (SELECT url, min(seq) AS seq FROM page_data WHERE url IS NOT NULL GROUP BY url) SELECT seq, url AS uri FROM first WHERE url NOT IN (SELECT url FROM page_content WHERE url IS NOT NULL)""")
def unseen_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests for addresses that were not visited, each once."""
    new = table(spark, d, "page_data").where(F.col("url").isNotNull()).select("seq", F.col("url").alias("uri"))
    return frontier.unseen(new, table(spark, d, "page_content").select(F.col("url").alias("uri"))).select("seq", "uri")


@query("""WITH store AS (SELECT url, title FROM page_content WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT d.seq, CASE WHEN s.url IS NULL THEN 404 ELSE 200 END AS status, CAST(coalesce(strlen(s.title), 0) AS BIGINT) AS n_bytes FROM page_data d LEFT JOIN store s ON d.url = s.url""")
def fetch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each request resolved against a store of pages: a left join, 404 for a miss."""
    pages = table(spark, d, "page_content").where(F.col("url").isNotNull())
    store = pages.groupBy(F.col("url").alias("uri")).agg(F.min(F.struct("seq", "title")).alias("p")).select("uri", F.col("p.title").cast("binary").alias("body"))
    got = TableBackend(store)(frontier.as_requests(table(spark, d, "page_data").withColumn("uri", F.col("url"))))
    return got.select("seq", "status", text.byte_length(F.col("response_body")).alias("n_bytes"))


# --- routes and runs -------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CASE lower(trim(processing_method)) WHEN 'rendered page' THEN 's:rendered page' WHEN 'static page' THEN 's:static page' ELSE 'fallback' END AS route FROM page_data)
SELECT route, CASE route WHEN 's:static page' THEN 'Skip' WHEN 'fallback' THEN 'Hold' ELSE 'Continue' END AS kind, CASE route WHEN 's:rendered page' THEN 'success' ELSE 'failure' END AS counted_as, count(*) AS n FROM r GROUP BY route""")
def route_by_method(spark: SparkSession, d: str) -> DataFrame:
    """One level over all rows of page_data, routed by their method."""
    router = Router().route("rendered page", constant(flow.proceed())).route("static page", constant(flow.skip())).fallback(constant(flow.hold(1000)))
    rows = table(spark, d, "page_data").select("seq", F.col("url").alias("uri"), F.lower(F.trim("processing_method")).alias("m"))
    tagged = rows.withColumn("tag", F.when(F.col("m").isNotNull(), tag_str(F.col("m")).cast(TAG)))
    run = Client(spark, router, NoopBackend()).run_once(tagged)
    key = tag_key(F.col("owner"))
    return run.outcomes.groupBy(F.when(key.isin(*router.all_keys()), key).otherwise("fallback").alias("route"), F.col("flow.kind").alias("kind"), "counted_as").agg(F.count(F.lit(1)).alias("n"))


def _entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """(uri, child_tag, child_uri, child_pos): region -> nation -> supplier and customer -> orders."""
    at = lambda kind, key: F.concat(F.lit(f"e://{kind}/"), F.col(key).cast("string"))
    edge = lambda name, up, up_key, kind, key: table(spark, d, name).select(at(up, up_key).alias("uri"), F.lit(kind).alias("child_tag"), at(kind, key).alias("child_uri"), F.col(key).cast("bigint").alias("child_pos"))
    parts = [edge("nation", "region", "n_regionkey", "nation", "n_nationkey"), edge("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"), edge("customer", "nation", "c_nationkey", "customer", "c_custkey"), edge("orders", "customer", "o_custkey", "orders", "o_orderkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _follow(edges: DataFrame, given: Column | None = None):
    """A handler that queues the children that ``edges`` has for a row, one level deeper, and writes the row."""

    def handler(rows: DataFrame, level_rows: int | None = None) -> Handled:
        up = frontier.for_join(rows.select(F.col("seq").alias("parent_seq"), F.col("tag").alias("parent_tag"), F.col("depth").alias("parent_depth"), "uri"), level_rows)
        below = up.join(edges, "uri").drop("uri").withColumnRenamed("child_uri", "uri")
        asked = below.select("parent_seq", "parent_tag", "parent_depth", "child_pos", "uri", F.lit("GET").alias("method"), F.lit("HTTP/1.1").alias("version"), F.lit(None).cast("bigint").alias("seq"), tag_str(F.col("child_tag")).cast(TAG).alias("tag"), F.lit(None).cast("bigint").alias("depth"), F.lit(None).cast("map<string,array<string>>").alias("headers"), F.lit(b"").alias("body"))
        return Handled(rows={"visits": rows.select("seq", "uri", F.col("tag.name").alias("kind"), "depth")}, children=frontier.in_handler().branch(asked), flow=given)

    handler.needs_body = False
    return handler


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("seq"), F.concat(F.lit("e://region/"), F.col("r_regionkey").cast("string")).alias("uri"), tag_str("region").cast(TAG).alias("tag"))


_VISITS = """WITH v AS (
    SELECT 'e://region/' || r_regionkey AS uri, 'region' AS kind, 1 AS depth FROM region
    UNION ALL SELECT 'e://nation/' || n_nationkey, 'nation', 2 FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'e://supplier/' || s_suppkey, 'supplier', 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'e://customer/' || c_custkey, 'customer', 3 FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'e://orders/' || o_orderkey, 'orders', 4 FROM orders JOIN customer ON o_custkey = c_custkey
)"""


@query(f"{_VISITS} SELECT uri, kind, CAST(depth AS BIGINT) AS depth FROM v")
def crawl_entities(spark: SparkSession, d: str) -> DataFrame:
    """The whole entity graph, crawled level by level over five tags."""
    follow = _follow(_entity_edges(spark, d))
    router = Router()
    for kind in ("region", "nation", "customer", "supplier", "orders"):
        router.route(kind, follow)
    return Client(spark, router, NoopBackend()).with_request_queue(_regions(spark, d)).run().rows["visits"].select("uri", "kind", "depth")


@query(f"{_VISITS} SELECT count(*) AS total, count(*) FILTER (kind <> 'supplier') AS succeeded, count(*) FILTER (kind = 'supplier') AS failed, count(*) FILTER (kind <> 'supplier') - count(*) FILTER (kind = 'supplier') AS load_code, count(*) FILTER (kind = 'supplier') AS load_doc, 4 AS levels FROM v")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the same crawl, in which suppliers are skipped."""
    edges = _entity_edges(spark, d)
    router = Router().route("supplier", constant(flow.skip())).fallback(_follow(edges))
    run = Client(spark, router, NoopBackend()).with_request_queue(_regions(spark, d)).run()
    return run.summary().select("total", "succeeded", "failed", "load_code", "load_doc", "levels")


@query(f"{_VISITS} SELECT kind, count(*) AS n FROM v WHERE kind IN ('region', 'nation', 'supplier') GROUP BY kind")
def crawl_abort(spark: SparkSession, d: str) -> DataFrame:
    """Nations end the run of customers; their requests, and so all orders, are dropped."""
    edges = _entity_edges(spark, d)
    end = flow.fail(flow.query("Single", tag_str("customer").cast(TAG)), errors.make_error("worker", F.lit("enough")))
    router = Router().route("nation", _follow(edges, end)).fallback(_follow(edges))
    run = Client(spark, router, NoopBackend(), on_fail="abort").with_request_queue(_regions(spark, d)).run()
    return run.rows["visits"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (
    SELECT 'e://region/' || r_regionkey AS uri, [-r_regionkey] AS path FROM region
    UNION ALL SELECT 'e://nation/' || n_nationkey, [-n_regionkey, -n_nationkey] FROM nation
    UNION ALL SELECT 'e://supplier/' || s_suppkey, [-n_regionkey, -n_nationkey, -s_suppkey, 0] FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'e://customer/' || c_custkey, [-n_regionkey, -n_nationkey, -c_custkey, 1] FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'e://orders/' || o_orderkey, [-n_regionkey, -n_nationkey, -c_custkey, 1, -o_orderkey] FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
) SELECT uri, row_number() OVER (ORDER BY path) AS visit FROM v""")
def crawl_depth_first(spark: SparkSession, d: str) -> DataFrame:
    """The order in which a stack would visit the whole entity graph."""
    run = Client(spark, Router().fallback(_follow(_entity_edges(spark, d))), NoopBackend(), order="lifo").with_request_queue(_regions(spark, d)).run()
    return frontier.ordered_by(run.requests.select("uri", "path"), F.col("path"), name="visit", folders=run.folders).select("uri", "visit")


@query("""WITH s AS (SELECT CAST(ceil(count(*) / 40.0) AS BIGINT) AS step FROM supplier)
SELECT 'e://supplier/' || s_suppkey AS uri, CAST(s_suppkey // step + 1 AS BIGINT) AS depth FROM supplier, s""")
def crawl_deep(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to 40 requests, each found by the one before it; nothing bounds the depth."""
    suppliers = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    step = suppliers.agg(F.ceil(F.count(F.lit(1)) / 40.0)).first()[0]
    uri = lambda k: F.concat(F.lit("e://supplier/"), k.cast("string"))
    edges = suppliers.where(F.col("k") >= step).select(uri(F.col("k") - step).alias("uri"), F.lit("supplier").alias("child_tag"), uri(F.col("k")).alias("child_uri"), F.col("k").alias("child_pos"))
    start = suppliers.where(F.col("k") < step).select(F.col("k").alias("seq"), uri(F.col("k")).alias("uri"))
    return Client(spark, Router().fallback(_follow(edges)), NoopBackend()).with_request_queue(start).run().requests.select("uri", "depth")


@query("""WITH RECURSIVE b AS (SELECT 0::BIGINT AS n, 1::BIGINT AS depth UNION SELECT (n + s) % 25, depth + 1 FROM b, (VALUES (1), (7)) t(s) WHERE depth < 20)
SELECT 'n://' || n AS uri, min(depth) AS depth FROM b GROUP BY n""")
def crawl_cycle(spark: SparkSession, d: str) -> DataFrame:
    """A graph of cycles, each address once."""
    n = F.col("n_nationkey").cast("bigint")
    to = F.explode(F.array(F.lit(1), F.lit(7)))
    edges = table(spark, d, "nation").select(F.concat(F.lit("n://"), n.cast("string")).alias("uri"), F.lit("n").alias("child_tag"), n.alias("_n"), to.alias("child_pos"))
    edges = edges.withColumn("child_uri", F.concat(F.lit("n://"), ((F.col("_n") + F.col("child_pos")) % 25).cast("string"))).drop("_n")
    start = spark.createDataFrame([(1, "n://0")], "seq bigint, uri string")
    run = Client(spark, Router().fallback(_follow(edges)), NoopBackend(), dedup="uri").with_request_queue(start).run()
    return run.requests.select("uri", "depth")


@query(rf"""WITH ok AS (SELECT seq, url FROM page_data WHERE regexp_matches(url, '{_VALID}') AND starts_with(url, 'http'))
SELECT seq, 'https://h.test/' || seq AS uri, 's:found' AS tag_key, 2::BIGINT AS depth FROM page_data WHERE url IS NOT NULL
UNION ALL SELECT seq, url, 's:found', 2 FROM ok""")
def link_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Links in JSON bodies become requests of a tag, one level deeper; a row's links are its first two."""
    rows = table(spark, d, "page_data").where(F.col("url").isNotNull())
    bodies = rows.select(F.col("seq"), F.concat(F.lit("d://"), F.col("seq").cast("string")).alias("uri"), F.to_json(F.struct(F.concat(F.lit("https://h.test/"), F.col("seq").cast("string")).alias("a"), F.col("url").alias("b"), F.lit("x").alias("c"))).alias("j"))

    def handler(level: DataFrame) -> Handled:
        found = children_of(level, json.links(extract.text().value))
        return Handled(children=frontier.in_handler().branch_with_tag("found", found))

    store = bodies.select("uri", F.col("j").cast("binary").alias("body"))
    run = Client(spark, Router().fallback(handler), TableBackend(store)).run_once(bodies.select("seq", "uri"))
    return run.left.select(F.col("parent_seq").alias("seq"), "uri", tag_key(F.col("tag")).alias("tag_key"), "depth")


# --- flow control ----------------------------------------------------------------------------------------------------

_FLOW_SQL = "CASE event_type WHEN 'click' THEN 'Continue' WHEN 'view' THEN 'Skip' WHEN 'purchase' THEN 'Wait' WHEN 'signup' THEN 'Hold' ELSE 'Fail' END"


def _event_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as outcomes: a flow by type, turned round for odd ids as an error's would be."""
    q = flow.query("Owner")
    kind = F.col("event_type")
    inner = (
        F.when(kind == "click", flow.proceed()).when(kind == "view", flow.skip()).when(kind == "purchase", flow.wait(F.floor(F.col("value") * 1000)))
        .when(kind == "signup", flow.hold(F.floor(F.col("value") * 1000))).otherwise(flow.fail(q, errors.make_error("worker", F.lit("end"))))
    )
    made = flow.from_result(F.col("event_id") % 2 == 0, inner.cast(FLOW))
    now = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), tag_str(kind).cast(TAG).alias("owner"), made.alias("flow"), now.alias("at_us"), kind.alias("event_type"))


_TURNED = f"(SELECT *, {_FLOW_SQL} AS k0 FROM events)"
_TURNED = f"(SELECT *, CASE WHEN event_id % 2 = 0 THEN k0 ELSE CASE k0 WHEN 'Continue' THEN 'Skip' WHEN 'Skip' THEN 'Continue' WHEN 'Wait' THEN 'Hold' WHEN 'Hold' THEN 'Wait' ELSE k0 END END AS kind FROM {_TURNED})"


@query(f"SELECT event_type, kind, CASE WHEN kind IN ('Continue', 'Wait') THEN 'success' ELSE 'failure' END AS counted_as, count(*) AS n FROM {_TURNED} GROUP BY ALL")
def flow_classify(spark: SparkSession, d: str) -> DataFrame:
    o = _event_outcomes(spark, d)
    return o.groupBy("event_type", F.col("flow.kind").alias("kind"), flow.counted_as(F.col("flow.kind")).alias("counted_as")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT event_type, count(*) AS total, count(*) FILTER (kind IN ('Continue', 'Wait')) AS succeeded FROM {_TURNED} GROUP BY event_type)
SELECT event_type, total, succeeded, total - succeeded AS failed, 2 * succeeded - total AS load_code, total - succeeded AS load_doc FROM o""")
def metric_load(spark: SparkSession, d: str) -> DataFrame:
    return flow.metrics(_event_outcomes(spark, d), "event_type")


_FOLD = f"""WITH e AS (SELECT 's:' || event_type AS tag_key, event_id, epoch_us(ts) AS now_us, CAST(floor(value * 1000) AS BIGINT) AS d FROM {_TURNED} WHERE kind IN ('Wait', 'Hold')),
c AS (SELECT *, sum(d) OVER (PARTITION BY tag_key ORDER BY event_id) AS cs FROM e)
SELECT tag_key, CAST(max(cs) + max(now_us - (cs - d)) AS BIGINT) AS not_before_us FROM c GROUP BY tag_key"""


@query(_FOLD)
def deferral_fold(spark: SparkSession, d: str) -> DataFrame:
    return flow.fold_deferrals(flow.deferral_rows(_event_outcomes(spark, d)))


@query(_FOLD)
def deferral_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same fold as the state of a stream."""
    from tidewheel.streaming import frontier as streaming

    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = flow.deferral_rows(_event_outcomes(spark, d)).select("seq", "tag_key", "now_us", "d_us")
    rows.write.parquet(f"{work}/in")
    query_ = streaming.deferral_stream(streaming.stream_of(spark, f"{work}/in", rows.schema), f"{work}/state", f"{work}/checkpoint")
    query_.awaitTermination()
    return streaming.deferral_state(spark, f"{work}/state", query_.lastProgress["batchId"])


@query("""SELECT event_id, event_type = 'click' AND event_id % 10 <> 0 AS by_owner, event_type = 'view' AS by_single, event_type IN ('view', 'signup') AS by_list, true AS by_every FROM events""")
def tag_query_match(spark: SparkSession, d: str) -> DataFrame:
    """Which tags each kind of query matches; every tenth event's owner is the fallback, which ``Owner`` never matches."""
    tag, tagged = tag_str(F.col("event_type")).cast(TAG), lambda n: tag_str(n).cast(TAG)
    owner = F.when(F.col("event_id") % 10 == 0, fallback_tag().cast(TAG)).otherwise(tagged("click"))
    asked = {"by_owner": flow.query("Owner"), "by_single": flow.query("Single", tagged("view")), "by_list": flow.query("List", tagged("view"), tagged("signup")), "by_every": flow.query("Every")}
    return table(spark, d, "events").select("event_id", *[flow.tag_matches(q, tag, owner).alias(n) for n, q in asked.items()])


@query("""SELECT CASE WHEN contains(title, 'http') OR contains(title, 'request') THEN 'http' WHEN contains(title, 'io') OR contains(title, 'file') THEN 'io' WHEN contains(title, 'timeout') THEN 'timeout' ELSE 'other' END AS kind, count(*) AS n FROM page_content GROUP BY 1""")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_content").groupBy(errors.infer_kind(F.col("title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (VALUES ('connection_failed', 'connection', 'http', true), ('webdriver', 'webdriver', 'backend', false), ('invalid_session', 'session', 'backend', false), ('timeout', 'timeout', 'timeout', true),
    ('pool_exhausted', 'pool', 'backend', true), ('configuration', 'config', 'backend', false), ('process_error', 'process', 'backend', false), ('element_error', 'element', 'worker', false), ('navigation_error', 'navigation', 'http', true),
    ('javascript_error', 'script', 'worker', false), ('resource_error', 'resource', 'io', true), ('capability_error', 'capability', 'backend', false), ('operation_failed', 'operation', 'backend', true)) t(name, category, kind, retryable)""")
def browser_errors(spark: SparkSession, d: str) -> DataFrame:
    """Category, kind and retryability of each browser error; the navigation error is one with status 503."""
    rows = spark.createDataFrame([(k,) for k in errors.BROWSER_ERRORS], "name string")
    n = F.col("name")
    return rows.select("name", errors.browser_category(n).alias("category"), errors.browser_kind(n).alias("kind"), errors.browser_retryable(n, F.lit("http"), F.lit(503)).alias("retryable"))

