import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import copies, mixing, seen, survivor

# --- survivors ---------------------------------------------------------------------------------------------------------

RECORDS = "seq long, email string, source_url string, processed_at timestamp_ntz, trust string, group_id string"
T = datetime


@pytest.mark.parametrize("email, ok", [("a@b.c", True), (" a.b-1@x.y.test \n", True), ("A@B.EXAMPLE", True), ("a@b", False), ("a@@b.c", False), ("a b@c.d", False), ("@b.c", False), ("a@", False), ("s***@b.c", False), ("fer…@b.c", False), ("none@none", False), ("xxxx@xxxx.com", False), ("a at b.c", False), ("", False), (None, False), ("a@b.c,", False), ("a.@b.c", False), ("x" * 100_000 + "@b.c", False), ("a@" + "b." * 50_000 + "c", False)])
def test_usable_email(spark, email, ok):
    assert spark.createDataFrame([(email,)], "e string").select(survivor.usable_email(F.col("e"))).first()[0] is ok


@pytest.mark.parametrize("url, host", [("https://A.b/x", "a.b"), (" HTTP://a.b:80?x= y\n", "a.b"), ("https://u:p@a.b", "a.b"), ("https://", ""), ("about:blank", ""), ("/v1/x", ""), ("a.b/x", ""), ("", ""), (None, ""), ("https://a.b." , "a.b"), ("https://a.b/" + "x" * 100_000, "a.b")])
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(survivor.host_of(F.col("u"))).first()[0] == host


def test_survivors(spark):
    day = lambda n: T(2024, 5, n)
    records = spark.createDataFrame(
        [
            (1, "a@b.c", "https://low.x/1", day(1), "t", "g"), (2, "z@b.c", "https://top.x/2", day(1), "t", "g"), (3, "y@b.c", "https://TOP.x/3", day(1), "t", "g"), (4, "bad", "https://top.x/4", T(2099, 1, 1), "t", "g"),
            (5, "q@b.c", "about:blank", day(9), "t", "g"), (6, None, None, None, None, None), (7, "only@b.c", None, T(1970, 1, 1), None, None), (8, "tie@b.c", "https://n.x", T(2025, 12, 31, 23, 59, 59), None, None), (9, "tie@b.c", "https://n.x", T(2025, 12, 31, 23, 59, 59), None, None),
        ],
        RECORDS,
    )
    groups = spark.createDataFrame([(10, 1), (10, 2), (10, 3), (10, 4), (10, 5), (10, 5), (11, 6), (11, 7), (12, 9), (12, 8), (13, 99), (None, 8)], "group_id long, seq long")
    trust = spark.createDataFrame([("top.x", 5), ("LOW.x ", 2), (None, 5), ("top.x", 1)], "host string, trust int")
    got = {r["group_id"]: (r["email_seq"], r["time_seq"], r["url_seq"]) for r in survivor.best_fields(groups, records, trust).collect()}
    assert got == {10: (2, 5, 2), 11: (7, None, None), 12: (8, 8, 8), 13: (None, None, None), None: (8, 8, 8)}
    assert survivor.best_fields(groups.limit(0), records, trust).count() == 0
    assert survivor.best_fields(groups, records.limit(0), trust.limit(0)).count() == 5


# --- copies ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("a, b, same", [
    ("https://a.b/x-y?p=1&q=2", " HTTPS://A.b/x_y/?q=2; p=1#\r\n", True), ("https://a.b/x?p=1&q=2", "https://a.b/x?p=2&q=1", False), ("https://a.b/x?p=1", "https://a.b/x?p=1&p=1", False), ("https://a.b/x", "https://a.b/x/?", True),
    ("", " - ", True), ("https://a.b/x1", "https://a.b/x2", False), ("a?p", "a?p=", True), ("é", "É", True), ("https://a.b?x=a=b", "https://a.b?x=ab", True),
])
def test_addresses(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(copies.bare_address(F.col("a")), copies.bare_address(F.col("b"))).first()
    assert (r[0] == r[1]) is same


def test_names(spark):
    r = spark.createDataFrame([("DARLOW, Neço", "neço  darlow.", "Neço Darlo", None)], "a string, b string, c string, d string").select(*[copies.bare_name(F.col(c)) for c in "abcd"]).first()
    assert r[0] == r[1] != r[2] and r[3] is None


def brute(rows, key):
    first, out = {}, set()
    for seq, *rest in sorted(rows):
        k = key(rest)
        if k in first:
            out.add((first[k], seq))
        else:
            first[k] = seq
    return out


def test_copies_are_those_of_brute_force(spark):
    rnd = random.Random(1)
    spell = lambda w: rnd.choice([w, w.upper(), f" {w}", f"{w}.", f"{w[0]}-{w[1:]}"])
    words = ["ab", "cd", "abc", None]
    rows = [(i, rnd.choice([1, 2, None]), (w := rnd.choice(words)) and spell(w), rnd.choice(["x", "y", None])) for i in range(400)]
    rows += [(1000 + i, 9, "hot", "z") for i in range(300)] + [(2000, 5, "L" * 100_000, ""), (2001, 5, "l" * 100_000 + "!", "")]
    df = spark.createDataFrame(rows, "seq long, id long, a string, _r0 string")
    bare = lambda s: s and "".join(c for c in s.lower() if c.isalnum())
    got = copies.copies_of_first(df, {"id": lambda c: c, "a": copies.bare, "_r0": copies.bare})
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda r: (r[0], bare(r[1]), bare(r[2])))
    _, groups = copies.collapse(df, {"id": lambda c: c, "a": copies.bare, "_r0": copies.bare})
    assert groups.agg(F.sum("copies")).first()[0] == len(rows)
    assert copies.copies_of_first(df.limit(0), {"a": copies.bare}).count() == 0


# --- keys seen before --------------------------------------------------------------------------------------------------


def test_filter_rate():
    f = seen.BlockedBloom(20_000, 0.001)
    h = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    f.insert(h)
    assert f.query(h).all()
    assert f.query(np.random.default_rng(2).integers(0, 2**64, 200_000, dtype=np.uint64)).mean() < 0.002


def test_filters_that_fill_up_keep_their_rate():
    f = seen.Filters(1_000, 0.01)
    rng = np.random.default_rng(3)
    for _ in range(20):
        f.query_then_insert(rng.integers(0, 2**64, 500, dtype=np.uint64))
    assert len(f.all) > 5 and f.query(rng.integers(0, 2**64, 50_000, dtype=np.uint64)).mean() < 0.02


@pytest.mark.parametrize("rate", [1e-5, 0.3])
def test_answers_are_those_of_brute_force_but_for_the_rate(spark, rate):
    rnd = random.Random(2)
    key = lambda: rnd.choice(["hot"] * 5 + [f"k{rnd.randint(0, 300)}", "", None, "é" * 1000])
    earlier = [(i, key()) for i in range(100)]
    stream = [(i, key() if i % 3 else f"u{i}") for i in rnd.sample(range(10_000), 2_000)]
    make = lambda rows: spark.createDataFrame(rows, "seq long, key string").repartition(3)
    tables = [make(earlier)], make(stream).withColumn("rank", F.lit("clash"))
    known, expect = {k for _, k in earlier}, set()
    for s, k in sorted(stream):
        if k is not None and k in known:
            expect.add(s)
        known.add(k)
    rows = seen.answers(*tables, rate=rate, keys_per_filter=300).collect()
    said = {r["seq"] for r in rows if r["maybe"]}
    assert len(rows) == sum(k is not None for _, k in stream) and said >= expect
    assert said == expect if rate < 0.1 else len(said - expect) < 2 * rate * (len(rows) - len(expect))
    assert {r["seq"] for r in seen.exact(*tables).where("seen").collect()} == expect
    told = seen.rates(*tables, rate=rate, probes=20_000, keys_per_filter=300).first()
    assert (told["asked"], told["said_yes"], told["wrong_yes"], told["wrong_no"]) == (len(rows), len(said), len(said - expect), 0)
    assert told["absent_asked"] >= 20_000 and told["absent_rate"] <= 1.5 * rate + 1e-4
    assert seen.answers([make(earlier).limit(0)], make(stream).limit(0)).count() == 0
    assert seen.rates([make(earlier).limit(0)], make(stream).limit(0)).first()["asked"] == 0


# --- mixing ------------------------------------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, n=3000):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big", "big", "big", "mid", "small", "other", None]), rnd.choice([0, 5, 20, 100, None]), "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, need string")


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.3, 3), ("absent", 0.1, 2)], TARGETS)
    sizes = mixing.sized(docs(spark), targets)
    plan = mixing.allot(sizes, targets)
    chosen = mixing.mix(sizes, plan).cache()
    assert chosen.select("doc_id").distinct().count() == chosen.count()
    got = {r["source"]: r for r in mixing.shares(chosen, plan).collect()}
    for s in ("big", "mid", "small"):
        assert abs(got[s]["actual_share"] - 1 / 3) < 0.005
    assert got["absent"]["tokens"] == 0
    most = {r["source"]: r["m"] for r in chosen.groupBy("source").agg(F.max("repeats").alias("m")).collect()}
    assert most["big"] <= 1 and most["mid"] <= 2 and most["small"] <= 3
    again = mixing.mix(sizes, mixing.allot(sizes, targets))
    assert again.exceptAll(chosen).count() == 0 and chosen.exceptAll(again).count() == 0


def test_weights_and_a_smaller_total(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 4)], TARGETS)
    weighted = docs(spark).withColumn("weight", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    sizes = mixing.sized(weighted, targets)
    plan = mixing.allot(sizes, targets, total_tokens=20_000)
    chosen = mixing.mix(sizes, plan)
    total = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).collect()
    assert all(abs(r["t"] - 10_000) <= 200 for r in total)
    even = chosen.groupBy((F.col("doc_id") % 2 == 0).alias("e")).agg(F.sum("repeats").alias("n")).collect()
    n = {r["e"]: r["n"] for r in even}
    assert n[True] > 2 * n[False]


def test_mixing_of_nothing(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), (None, 0.5, 1), ("none", None, None)], TARGETS)
    sizes = mixing.sized(docs(spark).limit(0), targets)
    assert mixing.mix(sizes, mixing.allot(sizes, targets)).count() == 0
    some = mixing.sized(docs(spark), targets.limit(0))
    assert mixing.mix(some, mixing.allot(some, targets.limit(0))).count() == 0
    with pytest.raises(ValueError):
        twice = targets.where("source = 'big'").unionByName(targets.where("source = 'big'"))
        mixing.allot(mixing.sized(docs(spark), twice), twice)
