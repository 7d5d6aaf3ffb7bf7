"""Extractors: columns made from a request and its response, with a rejection where they cannot be made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions import flow as flows
from tidewheel.functions.errors import make_error
from tidewheel.functions.json import kind
from tidewheel.functions.text import truncate_bytes
from tidewheel.schemas import ERROR, depth_or_first, tag_or_fallback


class Extracted:
    """``value``, and ``error``: null where the value was made."""

    def __init__(self, value: Column, error: Column | None = None):
        self.value = value
        self.error = (F.lit(None) if error is None else error).cast(ERROR)

    def optional(self) -> Extracted:
        """A rejection becomes null."""
        return Extracted(F.when(self.error.isNull(), self.value))

    def result(self) -> Extracted:
        """struct(value, error); never rejects."""
        return Extracted(F.struct(F.when(self.error.isNull(), self.value).alias("value"), self.error.alias("error")))


def body(column: str = "body") -> Extracted:
    return Extracted(F.coalesce(F.col(column), F.lit(b"")))


def text(column: str = "body") -> Extracted:
    """Strict UTF-8."""
    raw = F.coalesce(F.col(column), F.lit(b"")).cast("string")
    return Extracted(F.try_validate_utf8(raw), F.when(~F.is_valid_utf8(raw), make_error("context", F.lit("failed to parse UTF-8"))))


html = text


def _bad_json(bad: Column) -> Column:
    return F.when(bad, make_error("context", F.lit("failed to parse JSON")))


def json_value(column: str = "body") -> Extracted:
    """Any JSON value, as VARIANT."""
    v = F.try_parse_json(F.try_validate_utf8(F.col(column).cast("string")))
    return Extracted(v, _bad_json(v.isNull()))


def json_map(column: str = "body") -> Extracted:
    """A JSON object as a map of JSON texts; anything else is rejected."""
    s = F.try_validate_utf8(F.col(column).cast("string"))
    return Extracted(F.from_json(s, "map<string,string>"), _bad_json(F.coalesce(kind(s) != "object", F.lit(True))))


def json_as(ddl: str, column: str = "body") -> Extracted:
    """A JSON object as the row type ``ddl``; rejected where the text is no object or a field not of its type."""
    s = F.try_validate_utf8(F.col(column).cast("string"))
    v = F.from_json(s, f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = [x.name for x in _fields(ddl)]
    return Extracted(F.when(v.isNotNull(), F.struct(*[v[n].alias(n) for n in names])), _bad_json(v.isNull() | v["_bad"].isNotNull() | F.coalesce(kind(s) != "object", F.lit(True))))


def _fields(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fields


def uri() -> Extracted:
    return Extracted(F.col("uri"))


def tag() -> Extracted:
    return Extracted(tag_or_fallback(F.col("tag")))


def depth() -> Extracted:
    return Extracted(depth_or_first(F.col("depth")))


def rejection_flow(*extractors: Extracted) -> Column:
    """The flow of the first extractor that rejects; null if none does."""
    return F.coalesce(*[F.when(e.error.isNotNull(), flows.from_error(e.error)) for e in extractors])


def browser_content(html_: Column, inner_text: Column, extract_html: bool = True, extract_text: bool = False, most_bytes: int = 10 * 1024 * 1024) -> Column:
    """Content of a rendered page: HTML if asked for or if nothing is, else its text (``""`` where there is none), cut at a size."""
    chosen = html_ if extract_html or not extract_text else F.coalesce(inner_text, F.lit(""))
    return truncate_bytes(chosen, most_bytes)


def content_bytes(html_: str, inner_text: str | None, extract_html: bool, extract_text: bool, most_bytes: int) -> bytes:
    """The same of one page, where it is fetched in Python."""
    raw = (html_ if extract_html or not extract_text else inner_text or "").encode()
    if len(raw) > most_bytes:
        raw = raw[:most_bytes].decode(errors="ignore").encode()
    return raw
