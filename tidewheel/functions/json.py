"""Expressions over JSON texts. Invalid JSON and null give null; keys are taken in sorted order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(s: Column) -> Column:
    return F.try_parse_json(s)


def kind(s: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``."""
    k = F.schema_of_variant(parsed(s))
    return (
        F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k == "VOID", "null").when(k.isNotNull(), "number")
    )


def keys(s: Column) -> Column:
    """Sorted distinct keys of an object."""
    return F.array_sort(F.array_distinct(F.json_object_keys(s)))


def field_count(s: Column) -> Column:
    """Keys of an object, items of an array, 1 for anything else."""
    return F.when(kind(s) == "object", F.size(keys(s))).when(kind(s) == "array", F.json_array_length(s)).when(kind(s).isNotNull(), 1).cast("bigint")


def compact_size(s: Column) -> Column:
    """Bytes of the value written without white space."""
    return F.octet_length(F.to_json(parsed(s))).cast("bigint")


def text_at(s: Column, path: str) -> Column:
    """The string at ``path``; null where something else or nothing stands there."""
    v = F.try_variant_get(parsed(s), path, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(parsed(s), path, "string"))


def value_summary(s: Column) -> Column:
    """A string's first 50 characters in quotes, a number or boolean as it is, ``Array[n]``, ``Object{n}``, ``null``."""
    text = F.try_variant_get(parsed(s), "$", "string")
    n = field_count(s).cast("string")
    return (
        F.when(kind(s) == "string", F.concat(F.lit('"'), F.substring(text, 1, 50), F.lit('"')))
        .when(kind(s).isin("number", "boolean"), text)
        .when(kind(s) == "array", F.concat(F.lit("Array["), n, F.lit("]")))
        .when(kind(s) == "object", F.concat(F.lit("Object{"), n, F.lit("}")))
        .when(kind(s) == "null", "null")
    )


def first_entries(s: Column, count: int) -> Column:
    """The first ``count`` keys of an object."""
    return F.when(kind(s) == "object", F.slice(keys(s), 1, count))


def string_id(s: Column, most: int = 100_000) -> Column:
    """A number from 1 to ``most`` that depends on the text alone."""
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % most + 1).cast("bigint")


def user_fields(s: Column, source_url: Column) -> Column:
    """struct(id, name, email) of a user-like JSON document: a slideshow, an object with a uuid, any object, a string, or else."""
    is_object, has = kind(s) == "object", lambda k: F.array_contains(keys(s), k)
    show_kind = F.schema_of_variant(F.try_variant_get(parsed(s), "$.slideshow", "variant"))
    title, author = F.coalesce(text_at(s, "$.slideshow.title"), F.lit("API User")), F.coalesce(text_at(s, "$.slideshow.author"), F.lit("Unknown Author"))
    uuid = F.coalesce(text_at(s, "$.uuid"), F.lit("unknown-uuid"))
    short = F.substring(uuid, 1, 8)
    key = F.coalesce(F.array_min(keys(s)), F.lit("object"))
    text = F.try_variant_get(parsed(s), "$", "string")

    def user(id_: Column, name: Column, email: Column) -> Column:
        return F.struct(id_.cast("bigint").alias("id"), name.alias("name"), email.alias("email"))

    return (
        F.when(is_object & has("slideshow") & show_kind.startswith("OBJECT"), user(string_id(title), F.concat(title, F.lit(" ("), author, F.lit(")")), F.concat(F.replace(F.lower(author), F.lit(" "), F.lit(".")), F.lit("@api.example.com"))))
        .when(is_object & has("slideshow"), user(F.lit(1), F.lit("API Data"), F.lit("api@example.com")))
        .when(is_object & has("uuid"), user(string_id(uuid), F.concat(F.lit("UUID User "), short), F.concat(F.lit("uuid-"), short, F.lit("@api.example.com"))))
        .when(is_object, user(string_id(key), F.concat(F.lit("API Object User ("), key, F.lit(")")), F.concat(key, F.lit("@api.example.com"))))
        .when(kind(s) == "string", user(string_id(text), F.concat(F.lit("String User "), F.substring(text, 1, 8)), F.lit("string@api.example.com")))
        .when(kind(s).isNotNull(), user(string_id(source_url), F.lit("Generic API User"), F.lit("generic@api.example.com")))
    )


def links(s: Column, most: int = 2) -> Column:
    """The first ``most`` string values of an object that begin with ``http``, by key. The document is parsed once, to a map."""
    at = F.from_json(s, "map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(at), lambda e: F.struct(e["key"], e["value"])))
    values = F.transform(F.filter(entries, lambda e: F.startswith(e["value"], F.lit("http"))), lambda e: e["value"])
    return F.when(kind(s) == "object", F.slice(values, 1, most))


def discovery_rows(s: Column, url: Column) -> Column:
    """What is said of an object's fields and of the links found in it."""
    n = F.size(links(s))
    found = F.concat(F.lit("Discovered API endpoint: "), url, F.lit(" with "), field_count(s).cast("string"), F.lit(" fields"))
    more = F.when(n > 0, F.concat(F.lit("Discovered "), n.cast("string"), F.lit(" additional endpoints from "), url))
    return F.when(kind(s) == "object", F.array_compact(F.array(found, more)))
