"""Row types of requests, responses and outcomes, and builders of their columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TAG = "struct<kind:string,name:string,id:decimal(20,0)>"
HEADERS = "map<string,array<string>>"
QUERY = f"struct<kind:string,tags:array<{TAG}>>"
ERROR = f"struct<kind:string,message:string,source:string,query:{QUERY}>"
FLOW = f"struct<kind:string,query:{QUERY},duration_us:bigint,error:{ERROR}>"
REQUEST_DDL = f"seq bigint, parent_seq bigint, method string, uri string, version string, headers {HEADERS}, body binary, tag {TAG}, depth bigint"
RESPONSE_DDL = f"uri string, method string, status int, version string, headers {HEADERS}, body binary"
OUTCOME_DDL = f"seq bigint, owner {TAG}, flow {FLOW}, counted_as string, is_error boolean, at_us bigint"
MAX_DEPTH = 4_294_967_295


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def tag_str(name: str | Column) -> Column:
    """A tag by name; the empty name is a tag of its own."""
    name = name if isinstance(name, Column) else F.lit(name)
    return F.struct(F.lit("sequence").alias("kind"), name.alias("name"), F.lit(None).cast("decimal(20,0)").alias("id"))


def tag_id(value: int | Column) -> Column:
    """A tag by number; ``tag_id(1)`` and ``tag_str("1")`` differ."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.struct(F.lit("rehash").alias("kind"), F.lit(None).cast("string").alias("name"), value.cast("decimal(20,0)").alias("id"))


def fallback_tag() -> Column:
    return F.struct(F.lit("fallback").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("decimal(20,0)").alias("id"))


def as_tag(tag: str | int | Column | None) -> Column:
    """Tag of a name, a number, ``None`` (fallback) or a tag column."""
    if tag is None:
        return fallback_tag()
    if isinstance(tag, Column):
        return tag
    return tag_id(tag) if isinstance(tag, int) else tag_str(tag)


def tag_or_fallback(tag: Column) -> Column:
    return F.coalesce(tag.cast(TAG), fallback_tag().cast(TAG))


def tag_key(tag: Column) -> Column:
    """One string for each tag: kind and value."""
    t = tag_or_fallback(tag)
    return F.when(t["kind"] == "sequence", F.concat(F.lit("s:"), t["name"])).when(t["kind"] == "rehash", F.concat(F.lit("r:"), t["id"].cast("string"))).otherwise(F.lit("fallback"))


def key_of(tag: str | int | None) -> str:
    """:func:`tag_key` of a literal."""
    return "fallback" if tag is None else f"r:{tag}" if isinstance(tag, int) else f"s:{tag}"


def is_fallback(tag: Column) -> Column:
    return tag_or_fallback(tag)["kind"] == "fallback"


def depth_or_first(depth: Column) -> Column:
    """Depth counts from 1; absent and smaller ones are 1."""
    return F.greatest(F.coalesce(depth.cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")


def next_depth(depth: Column) -> Column:
    return F.least(depth_or_first(depth) + 1, F.lit(MAX_DEPTH)).cast("bigint")


def task_label(method: Column, uri: Column) -> Column:
    return F.concat_ws(" ", method, uri)


def body_of(value: Column | str | bytes | None) -> Column:
    """A binary body from text or bytes; nothing is the empty body."""
    if value is None:
        return F.lit(b"")
    if isinstance(value, bytes):
        return F.lit(value)
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(value.cast("binary"), F.lit(b""))


def body_size(body: Column) -> Column:
    return F.octet_length(F.coalesce(body, F.lit(b""))).cast("bigint")
