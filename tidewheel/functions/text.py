"""Measures of text bodies, as columns. All are null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for Java's and RE2's regular expressions alike.
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("bigint")


def line_count(s: Column) -> Column:
    """Lines end with a line feed; a last one without is a line, the empty text has none."""
    return (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) + F.when((s != "") & ~F.endswith(s, F.lit("\n")), 1).otherwise(0)).cast("bigint")


def word_count(s: Column) -> Column:
    """Runs of characters that are not Unicode white space."""
    return F.regexp_count(s, F.lit(rf"[^{WHITE}]+")).cast("bigint")


def char_count(s: Column) -> Column:
    return F.length(s).cast("bigint")


def is_robots(s: Column) -> Column:
    return F.contains(F.lower(s), F.lit("user-agent"))


def text_metadata(s: Column) -> Column:
    """``Lines``, ``Words`` and ``Characters``, and a mark for robots files."""
    say = lambda name, n: F.concat(F.lit(f"{name}: "), n.cast("string"))
    parts = F.array(say("Lines", line_count(s)), say("Words", word_count(s)), say("Characters", char_count(s)), F.when(is_robots(s), F.lit("Type: robots.txt")))
    return F.when(s.isNotNull(), F.array_compact(parts))


def content_kind(s: Column) -> Column:
    """JSON by its first character, HTML by the word in lower or upper case, else plain text."""
    return (
        F.when(s.rlike(rf"^[{WHITE}]*[\{{\[]"), "JSON-like text")
        .when(F.contains(s, F.lit("html")) | F.contains(s, F.lit("HTML")), "HTML-like text")
        .when(s.isNotNull(), "Plain text")
    )


def text_summary(s: Column, url: Column) -> Column:
    return F.concat(content_kind(s), F.lit(": "), url, F.lit(" ("), byte_length(s).cast("string"), F.lit(" bytes, "), line_count(s).cast("string"), F.lit(" lines)"))


def truncate_bytes(s: Column, limit: int) -> Column:
    """At most ``limit`` bytes, cut before a character rather than inside it."""
    raw = s.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, max(0, limit - k)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(raw) <= limit, s.cast("string")).when(raw.isNotNull(), F.coalesce(*cuts, F.lit("")))
