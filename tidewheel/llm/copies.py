"""Duplicates hidden by formatting differences: collapsed into one record each, with the number of copies.

Byte-identical rows are collapsed first, with counts; only the distinct survivors are brought to canonical text; those
are grouped again on the full canonical text, summing the counts. Both groupings combine before they exchange, so a hot
group sends one row a task. The way back from groups to rows is a join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Canonical = Callable[[Column], Column]

_NOISE = r"[\s\x{85}\p{Z}\p{P}$+<=>^`|~]+"
_PART_BREAK = r"[\s\x{85}\p{Z}\p{Pd}\p{Ps}\p{Pe}\p{Po}\p{Pc}$+<=>^`|~&&[^'’]]+"


def bare(c: Column) -> Column:
    """Lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(c), _NOISE, "")


def bare_address(c: Column) -> Column:
    """A web address without formatting: the part before ``?`` bare, then the query's fields, bare and in order."""
    query = F.split(F.regexp_extract(c, r"(?s)^[^?]*\?(.*)$", 1), "[&;#]")
    one = lambda f: F.concat(bare(F.split(f, "=", 2)[0]), F.lit("\x1e"), bare(F.coalesce(F.get(F.split(f, "=", 2), F.lit(1)), F.lit(""))))
    fields = F.array_sort(F.filter(F.transform(query, one), lambda f: f != "\x1e"))
    return F.concat(bare(F.substring_index(c, "?", 1)), F.lit("\x1d"), F.array_join(fields, "\x1f"))


def bare_name(c: Column) -> Column:
    """The parts of a name, bare and in order."""
    parts = F.transform(F.split(F.lower(c), _PART_BREAK), lambda p: F.regexp_replace(p, r"\p{P}", ""))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), " ")


def collapse(df: DataFrame, canonical: dict[str, Canonical]) -> tuple[DataFrame, DataFrame]:
    """(spellings, groups). ``canonical``: how the canonical text of each raw column is made; the rest does not count.

    spellings: raw columns ``_r0..``, canonical ``_c0..``, ``_first`` (smallest ``seq`` with these bytes), ``_n`` (rows).
    groups: ``_c0..``, ``first_seq``, ``copies`` (rows in the group, the first included).
    Null equals only null; an empty text equals all texts without letters and digits. Empty tables give empty results.
    """
    raw = [f"_r{i}" for i in range(len(canonical))]
    canon = [f"_c{i}" for i in range(len(canonical))]
    rows = df.select("seq", *[F.col(c).alias(r) for c, r in zip(canonical, raw)])
    spellings = rows.groupBy(*raw).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spellings = spellings.withColumns({c: e(F.col(r)) for c, r, e in zip(canon, raw, canonical.values())})
    groups = spellings.groupBy(*canon).agg(F.min("_first").alias("first_seq"), F.sum("_n").alias("copies"))
    return spellings, groups


def _fingerprint(columns: list[str]) -> Column:
    """128 bits of a cryptographic hash of the columns' bytes, null and empty told apart."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", *[part(c) for c in columns]), 256)), 1, 16)


def copies_of_first(df: DataFrame, canonical: dict[str, Canonical]) -> DataFrame:
    """(first_seq, seq) of each row that repeats an earlier one.

    Once grouped on its full canonical text, a spelling goes by its first ``seq`` and by fingerprints of that text and of its
    bytes instead of either, so neither join exchanges a text.
    """
    spellings, groups = collapse(df, canonical)
    canon = [c for c in groups.columns if c.startswith("_c")]
    raw = [c for c in spellings.columns if c.startswith("_r")]
    named = spellings.select(_fingerprint(canon).alias("_g"), _fingerprint(raw).alias("_f"), "_first", "_n")
    several = groups.where(F.col("copies") > 1).select(_fingerprint(canon).alias("_h"), "first_seq")
    # null-safe, though no fingerprint is null: a test for null would keep the two sides from sharing the first grouping
    placed = named.join(several, F.col("_g").eqNullSafe(F.col("_h"))).select("_f", "_first", "_n", "first_seq")
    single = placed.where((F.col("_n") == 1) & (F.col("_first") != F.col("first_seq"))).select("first_seq", F.col("_first").alias("seq"))
    repeated = placed.where(F.col("_n") > 1).select("_f", "first_seq")
    rows = df.select("seq", *[F.col(c).alias(r) for c, r in zip(canonical, raw)]).select("seq", _fingerprint(raw).alias("_f"))
    back = rows.join(repeated, "_f").where(F.col("seq") != F.col("first_seq")).select("first_seq", "seq")
    return single.unionByName(back)
