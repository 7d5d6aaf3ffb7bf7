import pytest
from pyspark.sql import functions as F

from tidewheel.functions import errors, flow
from tidewheel.schemas import FLOW, TAG, as_tag, body_of, body_size, depth_or_first, fallback_tag, is_fallback, next_depth, tag_id, tag_key, tag_str, task_label


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_tags(spark):
    r = one(spark, tag_key(tag_str("1")), tag_key(tag_id(1)), tag_key(F.lit(None).cast(TAG)), tag_key(tag_str("")), is_fallback(F.lit(None).cast(TAG)), is_fallback(tag_str("")), tag_key(as_tag(None)))
    assert list(r) == ["s:1", "r:1", "fallback", "s:", True, False, "fallback"]


def test_depth_and_bodies(spark):
    r = one(spark, depth_or_first(F.lit(None)), depth_or_first(F.lit(0)), depth_or_first(F.lit(2)), next_depth(F.lit(4294967295)), task_label(F.lit("GET"), F.lit("/x")), body_size(body_of("é")), body_size(body_of(None)))
    assert list(r) == [1, 1, 2, 4294967295, "GET /x", 2, 0]


def test_into_flow(spark):
    r = one(spark, flow.proceed()["kind"], flow.from_duration(F.lit(5))["kind"], flow.from_option(F.lit(None).cast(FLOW))["kind"], flow.from_option(flow.wait(3))["kind"], flow.duration_of(flow.hold(7)), flow.duration_of(flow.skip()), flow.query_of(flow.skip())["kind"])
    assert list(r) == ["Continue", "Wait", "Continue", "Wait", 7, 0, "Owner"]


@pytest.mark.parametrize("made, turned", [("proceed", "Skip"), ("skip", "Continue")])
def test_error_flips(spark, made, turned):
    f = getattr(flow, made)()
    r = one(spark, flow.from_result(F.lit(False), f)["kind"], flow.from_result(F.lit(True), f)["kind"])
    assert r[0] == turned and r[1] != turned


def test_error_of_a_handler_counts_as_success_but_a_rejection_does_not(spark):
    e = errors.make_error("worker", F.lit("x"))
    held = flow.from_error(e)
    r = one(spark, held["kind"], flow.counted_as(held["kind"]), flow.counted_as(flow.from_result(F.lit(False), held)["kind"]), flow.flipped(flow.fail(flow.query("Every"), e))["kind"])
    assert list(r) == ["Hold", "failure", "success", "Fail"]


def test_error_with_query_fails(spark):
    e = errors.make_error("http", F.lit("m"), source=F.lit("s"), query=flow.query("Every"))
    r = one(spark, flow.from_error(e)["kind"], flow.error_of(flow.from_error(e))["message"], errors.display(e))
    assert list(r) == ["Fail", "s", "[http] m"]


@pytest.mark.parametrize("message, kind", [("http x", "http"), ("request", "http"), ("file", "io"), ("connection timeout", "io"), ("timeout", "timeout"), ("x", "other"), ("HTTP", "other"), (None, "other")])
def test_error_kind(spark, message, kind):
    assert one(spark, errors.infer_kind(F.lit(message).cast("string")))[0] == kind


def test_browser_errors(spark):
    n = lambda kind, status: errors.browser_retryable(F.lit("navigation_error"), F.lit(kind), F.lit(status).cast("int"))
    r = one(spark, n("http", 500), n("http", 404), n("http", None), n("timeout", None), n("network", None), n("blocked", None), errors.browser_retryable(F.lit("timeout")), errors.browser_retryable(F.lit("configuration")))
    assert list(r) == [True, False, False, True, True, False, True, False]
    r = one(spark, errors.browser_message("timeout", operation=F.lit("x"), duration_secs=F.lit(3)), errors.browser_message("configuration", field=F.lit(None).cast("string"), message=F.lit("m")), errors.navigation_text(F.lit("http"), F.lit(500)))
    assert list(r) == ["Operation 'x' timed out after 3 seconds", "Configuration error: m", "HTTP error 500"]


def outcomes(spark, rows):
    """rows: (seq, owner or None, kind, query, tags, duration, now)"""
    df = spark.createDataFrame(rows, "seq bigint, o string, kind string, q string, tags array<string>, d bigint, at_us bigint")
    tags = F.transform("tags", lambda t: tag_str(t).cast(TAG))
    f = F.struct(F.col("kind").alias("kind"), F.struct(F.col("q").alias("kind"), tags.alias("tags")).alias("query"), F.col("d").alias("duration_us"), F.lit(None).alias("error")).cast(FLOW)
    return df.select("seq", F.when(F.col("o").isNotNull(), tag_str(F.col("o")).cast(TAG)).otherwise(fallback_tag().cast(TAG)).alias("owner"), f.alias("flow"), "at_us")


def test_deferral_fold_is_the_sequential_rule(spark):
    import random

    rnd = random.Random(3)
    rows, state = [], {}
    for i in range(400):
        owner = rnd.choice(["a", "b", None])
        q, tags = rnd.choice([("Owner", []), ("Single", ["a"]), ("List", ["a", "c"]), ("Every", [])])
        kind, d, now = rnd.choice(["Wait", "Hold", "Skip"]), rnd.randint(0, 50), 1000 + rnd.randint(-200, 200) + i
        rows.append((i * 70_001, owner, kind, q, tags, d, now))
        keys = {"Owner": [f"s:{owner}" if owner else "fallback"], "Single": ["s:a"], "List": ["s:a", "s:c"], "Every": ["fallback"]}[q]
        for k in keys if kind != "Skip" else []:
            state[k] = now + d if k not in state else max(state[k] + d, now + d)
    got = flow.fold_deferrals(flow.deferral_rows(outcomes(spark, rows)))
    assert {r["tag_key"]: r["not_before_us"] for r in got.collect()} == state


def test_metrics_may_be_negative(spark):
    r = flow.metrics(outcomes(spark, [(1, "a", "Skip", "Owner", [], 0, 0), (2, "a", "Fail", "Owner", [], 0, 0), (3, "a", "Wait", "Owner", [], 0, 0)])).first()
    assert (r["total"], r["succeeded"], r["failed"], r["load_code"], r["load_doc"]) == (3, 1, 2, -1, 2)


def test_tag_queries(spark):
    a, b = tag_str("a").cast(TAG), tag_str("b").cast(TAG)
    nobody = fallback_tag().cast(TAG)
    r = one(
        spark, flow.tag_matches(flow.query("Owner"), a, a), flow.tag_matches(flow.query("Owner"), nobody, nobody), flow.tag_matches(flow.query("Single", a), b, a),
        flow.tag_matches(flow.query("List", a, b), b, a), flow.tag_matches(flow.query("Every"), b, a), flow.tag_matches(flow.query("Single"), b, a),
    )
    assert list(r) == [True, False, False, True, True, False]
