"""Best representative of each duplicate group: one surviving record, each field from the record that serves it best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A trust table up to this many rows is broadcast; a larger one is joined by exchange.
BROADCAST_ROWS = 10_000
_BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
# What stands in for the local part or host of an address.
STAND_INS = ("none", "null", "nan", "na", "unknown", "hidden", "redacted", "noemail", "noreply", "example", "invalid", "xxx", "xxxx", "test")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), _BLANK, "")


def usable_email(c: Column) -> Column:
    """One complete address with a dotted host, neither masked, cut nor a stand-in; false for null."""
    t = F.lower(trimmed(c))
    local = F.split_part(t, F.lit("@"), F.lit(1))
    shaped = t.rlike(r"^[^\s@,;:<>()\[\]\"*…?#/\\]+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+$")
    whole = ~t.rlike(r"\.\.|^\.|\.@|^xx+@|@xx+\.") & ~local.isin(*STAND_INS)
    # An address has 254 characters at most; longer texts are not matched at all.
    return F.when(F.length(t) <= 254, F.coalesce(shaped & whole, F.lit(False))).otherwise(False)


def host_of(c: Column) -> Column:
    """Lower-case host of an absolute web address, empty if it is none."""
    return F.coalesce(F.lower(F.regexp_extract(trimmed(c), r"(?is)^https?://(?:[^/?#@\s]*@)?([\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?)\.?(?::\d+)?(?:[/?#].*)?$", 1)), F.lit(""))


def best_rows(groups: DataFrame, records: DataFrame, trust: DataFrame, first_day: str = "2024-01-01", after_last: str = "2026-01-01") -> DataFrame:
    """One row per ``group_id``: the ``seq`` that ``email``, ``processed_at`` and ``source_url`` come from.

    Email and address: among usable ones the highest trust of the row's own host, then the latest usable time, then the
    smallest ``seq``. Time: the latest from ``first_day`` until before ``after_last``, then the smallest ``seq``. A field
    without a usable value has a null ``seq``; so has every field of a group none of whose rows exists. A row listed twice
    counts once. Records in no group play no part; further columns of the tables are not looked at.

    What decides is worked out where a record is read; its texts go nowhere. One window ranks all three fields. Its rank
    limit is applied before the exchange as well as after it, so a group of any size sends one row a field and task.
    """
    kind = records.schema["processed_at"].dataType.simpleString()
    at = F.col("processed_at")
    in_time = F.coalesce((at >= F.lit(first_day).cast(kind)) & (at < F.lit(after_last).cast(kind)), F.lit(False))
    rows = records.select("seq", F.coalesce(usable_email(F.col("email")), F.lit(False)).alias("_mail"), host_of(F.col("source_url")).alias("_host"), F.when(in_time, at).alias("_at"))
    trusted = trust.where(F.col("host").isNotNull()).groupBy(F.lower(trimmed(F.col("host"))).alias("_host")).agg(F.max("trust").alias("_trust"))
    if trust.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    level = F.when(F.col("_host") != "", F.coalesce(F.col("_trust").cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    rows = rows.join(trusted, "_host", "left").select("seq", "_mail", (F.col("_host") != "").alias("_web"), level.alias("_level"), "_at")
    member = groups.select("group_id", "seq").join(rows, "seq", "left")

    def option(field: str, usable: Column, trust_: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.coalesce(usable, F.lit(False)).alias("usable"), trust_.alias("trust"))

    options = F.array(option("email", F.col("_mail"), F.col("_level")), option("url", F.col("_web"), F.col("_level")), option("time", F.col("_at").isNotNull(), F.lit(0).cast("long")))
    ranked = member.select("group_id", "seq", "_at", F.explode(options).alias("o")).select("group_id", "seq", "_at", "o.*")
    order = Window.partitionBy("group_id", "field").orderBy(F.desc("usable"), F.desc("trust"), F.desc_nulls_last("_at"), F.asc("seq"))
    top = ranked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1)
    of = lambda field: F.max(F.when((F.col("field") == field) & F.col("usable"), F.col("seq")))
    return top.groupBy("group_id").agg(of("email").alias("email_seq"), of("time").alias("time_seq"), of("url").alias("url_seq"))


def best_fields(groups: DataFrame, records: DataFrame, trust: DataFrame, **days) -> DataFrame:
    """:func:`best_rows` with the values: ``email``, ``processed_at`` and ``source_url`` from the rows chosen, null where there is none.

    At most three rows a group are looked up among the records, each by its ``seq``.
    """
    best = best_rows(groups, records, trust, **days)
    asked = best.select("group_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_seq").alias("seq")) for f in ("email", "time", "url")])).alias("o")).select("group_id", "o.*").where(F.col("seq").isNotNull())
    value = F.when(F.col("field") == "email", F.col("email")).when(F.col("field") == "url", F.col("source_url"))
    found = asked.join(records.select("seq", "email", "source_url", "processed_at"), "seq").select("group_id", "seq", "field", value.alias("value"), F.when(F.col("field") == "time", F.col("processed_at")).alias("at"))
    pick = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    chosen = found.groupBy("group_id").agg(*[pick(f, "seq").alias(f"{f}_seq") for f in ("email", "time", "url")], pick("email", "value").alias("email"), pick("time", "at").alias("processed_at"), pick("url", "value").alias("source_url"))
    nothing = best.where(F.coalesce("email_seq", "time_seq", "url_seq").isNull())  # groups of which no row is usable
    return chosen.unionByName(nothing, allowMissingColumns=True)
