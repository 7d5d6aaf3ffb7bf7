"""Flow control: what a handler returns, how it is counted, and the deferral state it folds into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.errors import from_message
from tidewheel.schemas import ERROR, FLOW, QUERY, TAG, fallback_tag, is_fallback, tag_key, tag_or_fallback

SUCCESS, FAILURE = ("Continue", "Wait"), ("Skip", "Hold", "Fail")
_FLIP = {"Continue": "Skip", "Skip": "Continue", "Wait": "Hold", "Hold": "Wait", "Fail": "Fail"}


def query(kind: str, *tags: Column) -> Column:
    """A tag query: ``Owner``, ``Single``, ``List`` or ``Every``."""
    return F.struct(F.lit(kind).alias("kind"), (F.array(*tags) if tags else F.array()).cast(f"array<{TAG}>").alias("tags")).cast(QUERY)


def _flow(kind: str | Column, q: Column | None = None, duration_us: Column | int | None = None, error: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    us = duration_us if isinstance(duration_us, Column) else F.lit(duration_us)
    return F.struct(
        kind.alias("kind"), (F.lit(None) if q is None else q).cast(QUERY).alias("query"), us.cast("bigint").alias("duration_us"), (F.lit(None) if error is None else error).cast(ERROR).alias("error")
    ).cast(FLOW)


def proceed() -> Column:
    return _flow("Continue")


def skip() -> Column:
    return _flow("Skip")


def wait(duration_us: Column | int, q: Column | None = None) -> Column:
    return _flow("Wait", query("Owner") if q is None else q, duration_us)


def hold(duration_us: Column | int, q: Column | None = None) -> Column:
    return _flow("Hold", query("Owner") if q is None else q, duration_us)


def fail(q: Column, error: Column) -> Column:
    return _flow("Fail", q, None, error)


def from_duration(us: Column) -> Column:
    return wait(us)


def from_option(inner: Column) -> Column:
    """A null flow is ``Continue``."""
    return F.coalesce(inner, proceed())


def from_error(error: Column) -> Column:
    """With a query the run of its tags is to end; without one the owner is held for no time."""
    told = F.struct(error["kind"].alias("kind"), F.coalesce(error["source"], error["message"]).alias("message"), error["source"].alias("source"), error["query"].alias("query")).cast(ERROR)
    return F.when(error["query"].isNotNull(), fail(error["query"], told)).otherwise(hold(0))


def from_boxed(message: Column) -> Column:
    return from_error(from_message(message))


def flipped(flow: Column) -> Column:
    """Success and failure exchanged; ``Fail`` stays."""
    kind = F.create_map(*[F.lit(x) for p in _FLIP.items() for x in p])[flow["kind"]]
    return F.when(flow.isNotNull(), F.struct(kind.alias("kind"), flow["query"].alias("query"), flow["duration_us"].alias("duration_us"), flow["error"].alias("error")).cast(FLOW))


def from_result(ok: Column, inner: Column) -> Column:
    """An error's flow is flipped, so an error without a query counts as a success; kept as observed."""
    return F.when(ok, inner).otherwise(flipped(inner))


def duration_of(flow: Column) -> Column:
    return F.when(flow["kind"].isin("Wait", "Hold"), F.coalesce(flow["duration_us"], F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def query_of(flow: Column) -> Column:
    return F.when(flow["kind"].isin("Wait", "Hold", "Fail"), F.coalesce(flow["query"], query("Owner"))).otherwise(query("Owner"))


def error_of(flow: Column) -> Column:
    return F.when(flow["kind"] == "Fail", flow["error"])


def counted_as(kind: Column) -> Column:
    return F.when(kind.isin(*SUCCESS), "success").when(kind.isin(*FAILURE), "failure")


def tag_matches(q: Column, tag: Column, owner: Column) -> Column:
    """Whether a query holds for ``tag``. ``Owner`` never matches where the owner is the fallback."""
    key = tag_key(tag)
    return (
        F.when(q["kind"] == "Owner", ~is_fallback(owner) & (key == tag_key(owner)))
        .when(q["kind"] == "Single", F.coalesce(key == tag_key(F.get(q["tags"], F.lit(0))), F.lit(False)))
        .when(q["kind"] == "List", F.exists(q["tags"], lambda t: tag_key(t) == key))
        .otherwise(q["kind"] == "Every")
    )


def metrics(outcomes: DataFrame, *by: Column | str) -> DataFrame:
    """Success and failure counts, their difference (signed), and failures as the documented load."""
    kind = F.col("flow")["kind"]
    ok, bad = F.count_if(kind.isin(*SUCCESS)), F.count_if(kind.isin(*FAILURE))
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), ok.alias("succeeded"), bad.alias("failed"), (ok - bad).alias("load_code"), bad.alias("load_doc"))


def deferral_rows(outcomes: DataFrame) -> DataFrame:
    """(seq, tag_key, now_us, d_us): one row per key that a ``Wait`` or ``Hold`` defers.

    The owner's key, fallback included; the tag of ``Single``; each tag of ``List``; for ``Every`` only the fallback's.
    """
    q = query_of(F.col("flow"))
    owner = tag_or_fallback(F.col("owner"))
    keys = (
        F.when(q["kind"] == "Owner", F.array(tag_key(owner)))
        .when(q["kind"] == "Single", F.array(tag_key(F.get(q["tags"], F.lit(0)))))
        .when(q["kind"] == "List", F.transform(q["tags"], tag_key))
        .otherwise(F.array(tag_key(fallback_tag())))
    )
    return outcomes.where(F.col("flow")["kind"].isin("Wait", "Hold")).select(
        "seq", F.posexplode(keys).alias("_pos", "tag_key"), F.col("at_us").alias("now_us"), duration_of(F.col("flow")).alias("d_us")
    )


def run_deferrals(rows: DataFrame) -> DataFrame:
    """(tag_key, d, m): each key's rows in ``seq`` order as one run, its sum of d and its greatest (now - sum of d before it).

    The rule (first: now + d; later: the greater of the time so far and now, + d) is a max-plus fold, so runs join
    associatively: after a run the time is d + the greater of m and the time before. A key is folded in runs of consecutive
    ``seq``, so that a hot key is spread over tasks; then its runs are folded.
    """
    from pyspark.sql import Window

    run = F.floor(F.col("seq") / F.lit(100_000))
    inner = Window.partitionBy("tag_key", "_run").orderBy("seq", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos = F.col("_pos") if "_pos" in rows.columns else F.lit(0)
    runs = (
        rows.withColumn("_pos", pos)
        .withColumn("_run", run)
        .withColumn("_cs", F.sum("d_us").over(inner))
        .groupBy("tag_key", "_run")
        .agg(F.sum("d_us").alias("_d"), F.max(F.col("now_us") - (F.col("_cs") - F.col("d_us"))).alias("_m"))
    )
    outer = Window.partitionBy("tag_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = runs.withColumn("_before", F.sum("_d").over(outer) - F.col("_d"))
    return joined.groupBy("tag_key").agg(F.sum("_d").cast("bigint").alias("d"), F.max(F.col("_m") - F.col("_before")).cast("bigint").alias("m"))


def fold_deferrals(rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(tag_key, not_before_us) after all rows in ``seq`` order, which come after what led to ``before`` (of the same columns)."""
    runs = run_deferrals(rows)
    if before is None:
        return runs.select("tag_key", (F.col("d") + F.col("m")).alias("not_before_us"))
    both = runs.join(before, "tag_key", "full")
    after = F.coalesce(F.col("d") + F.greatest("m", "not_before_us"), F.col("not_before_us"))
    return both.select("tag_key", after.alias("not_before_us"))


def aborted_tags(outcomes: DataFrame) -> DataFrame:
    """(query, owner) of outcomes that ask for an end."""
    return outcomes.where(F.col("flow")["kind"] == "Fail").select(query_of(F.col("flow")).alias("query"), tag_or_fallback(F.col("owner")).alias("owner"))
