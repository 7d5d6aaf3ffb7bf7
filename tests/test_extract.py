import pytest
from pyspark.sql import functions as F

from tidewheel.functions import extract, json, select, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize("s, lines, words, chars", [("", 0, 0, 0), ("a", 1, 1, 1), ("a\n", 1, 1, 2), ("a\n\nb c", 3, 3, 6), ("\n", 1, 0, 1), ("x y　z", 1, 3, 5), (None, None, None, None)])
def test_counts(spark, s, lines, words, chars):
    assert (one(spark, s, text.line_count), one(spark, s, text.word_count), one(spark, s, text.char_count)) == (lines, words, chars)


def test_metadata_and_kind(spark):
    assert one(spark, "User-Agent: *", text.text_metadata) == ["Lines: 1", "Words: 2", "Characters: 13", "Type: robots.txt"]
    assert [one(spark, s, text.content_kind) for s in (" {", " [1]", "<html>", "<Html>", "")] == ["JSON-like text", "JSON-like text", "HTML-like text", "Plain text", "Plain text"]


@pytest.mark.parametrize("s, n, expect", [("aé", 2, "a"), ("aé", 3, "aé"), ("a😀b", 4, "a"), ("a😀b", 5, "a😀"), ("é", 1, ""), ("", 5, ""), (None, 5, None), ("x" * 50_000, 40_000, "x" * 40_000)])
def test_truncation_keeps_characters_whole(spark, s, n, expect):
    assert one(spark, s, lambda c: text.truncate_bytes(c, n)) == expect


@pytest.mark.parametrize("s, kind, n, summary", [('{"b": 1, "a": [1]}', "object", 2, "Object{2}"), ("[1, 2]", "array", 2, "Array[2]"), ('"x"', "string", 1, '"x"'), ("1.5", "number", 1, "1.5"), ("true", "boolean", 1, "true"), ("null", "null", 1, "null"), ("{bad", None, None, None), (None, None, None, None), ("{}", "object", 0, "Object{0}")])
def test_json(spark, s, kind, n, summary):
    assert (one(spark, s, json.kind), one(spark, s, json.field_count), one(spark, s, json.value_summary)) == (kind, n, summary)


def test_json_long_string_and_users(spark):
    assert one(spark, '"' + "x" * 80 + '"', json.value_summary) == '"' + "x" * 50 + '"'
    user = lambda s: one(spark, s, lambda c: json.user_fields(c, F.lit("u")))
    assert user('{"slideshow": {"title": "T", "author": "A B"}}')["email"] == "a.b@api.example.com"
    assert user('{"slideshow": {}}')["name"] == "API User (Unknown Author)"
    assert user('{"uuid": "abc"}')["name"] == "UUID User abc"
    assert user("{}")["name"] == "API Object User (object)"
    assert user("7")["name"] == "Generic API User"
    assert user("{")is None


def bodies(spark, *raw):
    return spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(raw)], "i int, body binary")


def test_strict_text_and_rejections(spark):
    t = extract.text()
    rows = bodies(spark, b"ok", b"\x80", None).select(t.value.alias("v"), t.error["kind"].alias("k"), t.optional().value.alias("o"), extract.rejection_flow(t)["kind"].alias("f"), t.result().value["error"]["message"].alias("m")).collect()
    assert [tuple(r) for r in rows] == [("ok", None, "ok", None, None), (None, "context", None, "Hold", "failed to parse UTF-8"), ("", None, "", None, None)]


def test_json_extractors(spark):
    j, m, v = extract.json_as("a int, b string"), extract.json_map(), extract.json_value()
    rows = bodies(spark, b'{"a": 1, "b": "x"}', b"[1]", b"{", b"").select(j.value.alias("j"), j.error.isNotNull().alias("je"), m.error.isNotNull().alias("me"), v.error.isNotNull().alias("ve")).collect()
    assert rows[0]["j"]["a"] == 1 and [tuple(r)[1:] for r in rows] == [(False, False, False), (True, True, False), (True, True, True), (True, True, True)]


HTML = "<div id=m class='a b'><p>one<p>two <b>x</b></div><ul><li class=i data-p='1.5'>A</li><li class=i>B</li></ul><script>var t='<li class=i>';</script><!-- <li class=i> -->"


@pytest.mark.parametrize("css, n", [("p", 2), ("#m > p", 2), (".a.b", 1), ("li.i[data-p]", 1), ("li[data-p='1.5']", 1), ("ul li", 2), ("div li", 0), ("p, li", 4), ("*", 8)])
def test_selectors(css, n):
    assert len(select.find(select.parse(HTML), select.compile_css(css))) == n


@pytest.mark.parametrize("css", ["", "a:hover", "a + b", "a ~ b"])
def test_selectors_that_are_refused(css):
    with pytest.raises(ValueError):
        select.compile_css(css)


def test_elements(spark):
    made = lambda **k: one(spark, HTML, lambda c: select.elements(c, {"name": select.Field("li.i"), "price": select.Field("li.i", attr="data-p", kind="double", **k)}))
    assert [tuple(r) for r in made(required=False)] == [("A", 1.5), ("B", None)]
    assert [tuple(r) for r in made()] == [("A", 1.5)]
    assert one(spark, None, lambda c: select.elements(c, {"p": select.Field("p")})) is None
    v = one(spark, "<title>T &amp; x</title><body>a<p>b</body>", lambda c: select.view(c, F.lit("u")))
    assert (v["title"], v["text"], v["current_url"]) == ("T & x", "ab", "u")


@pytest.mark.parametrize("html, inner, flags, expect", [("<p>", "t", (True, True), "<p>"), ("<p>", "t", (False, True), "t"), ("<p>", None, (False, True), ""), ("<p>", "t", (False, False), "<p>")])
def test_browser_content(spark, html, inner, flags, expect):
    assert one(spark, html, lambda c: extract.browser_content(c, F.lit(inner).cast("string"), *flags)) == expect
