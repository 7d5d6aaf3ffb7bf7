"""Mixing sources to target weights by Pareto order sampling.

Each source is given as many tokens as its share of the largest total that all sources can fill within their caps. A
document's expected copies are proportional to its weight, up to the cap: the whole part of them is certain, the rest is
its inclusion probability in one sample more. That sample takes documents by rising (odds of a random number) / (odds of
inclusion) until the source has its tokens. The random number is a hash of the id, so a task that runs again gives the
same. No source is sorted as a whole: counts by bins of the ranking value find the bin in which the source is full, and
only that bin (one in ``BINS`` documents) is ordered exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import cut

BINS = 65_536
#: Targets are a fixed list; a longer one is refused rather than broadcast.
MOST_TARGETS = 10_000
_SHAPE = "source string, target_share double, max_repeats int, available long, need double, per_weight double, mean double"


def sized(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents (``doc_id, source, n_tokens`` and perhaps ``weight``) of listed sources that have any tokens, written once."""
    listed = F.broadcast(targets.limit(MOST_TARGETS).select("source").where(F.col("source").isNotNull()).distinct())
    weight = F.col("weight") if "weight" in documents.columns else F.lit(1.0)
    own = documents.where(F.col("n_tokens") > 0).select("doc_id", "source", "n_tokens", weight.cast("double").alias("weight"))
    return cut(own.join(listed, "source", "left_semi"))


def allot(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """What each target source needs; at most ``MOST_TARGETS`` rows come to the driver, and as many times 1024 weight bins.

    A listed source without documents needs nothing, and the others' shares are scaled up alike. Equal targets must be
    listed once. ``total_tokens`` asks for less than the most that the caps allow.
    """
    want = [r.asDict() for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).limit(MOST_TARGETS + 1).collect()]
    if len(want) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if len({w["source"] for w in want}) < len(want):
        raise ValueError("a source is listed more than once")
    bin_ = F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(F.log2("weight") * 16 + 512)))
    by_bin = sizes.where(F.col("weight") > 0).groupBy("source", bin_.alias("b")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("weight")).alias("tw")).collect()
    bins: dict[str, list] = {}
    for r in by_bin:
        bins.setdefault(r["source"], []).append((r["tw"] / r["t"], r["t"]))
    there = [w for w in want if w["source"] in bins and w["max_repeats"] and w["max_repeats"] > 0]
    left = sum(w["target_share"] for w in there)
    most = min((w["max_repeats"] * sum(t for _, t in bins[w["source"]]) * left / w["target_share"] for w in there), default=0.0)
    total = min(most, total_tokens) if total_tokens is not None else most
    out = []
    for w in want:
        own, cap = bins.get(w["source"], []), w["max_repeats"] or 0
        need = total * w["target_share"] / left if w in there else 0.0
        low, high = 0.0, 1.0
        filled = lambda c: sum(min(cap, c * x) * t for x, t in own)  # noqa: E731, B023
        while own and need and filled(high) < need * (1 - 1e-12) and high < 1e30:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if filled(mid) < need else (low, mid)
        available = sum(t for _, t in own)
        out.append({"source": w["source"], "target_share": w["target_share"], "max_repeats": cap, "available": available, "need": need, "per_weight": high if need else 0.0, "mean": need / available % 1 if available else 0.0})
    return out


def _shared(sizes: DataFrame, plan: list[dict]) -> DataFrame:
    return F.broadcast(sizes.sparkSession.createDataFrame([tuple(p[k.split()[0]] for k in _SHAPE.split(", ")) for p in plan], _SHAPE))


def _expected() -> Column:
    """Copies that a document's weight asks for."""
    return F.least(F.col("max_repeats").cast("double"), F.col("per_weight") * F.col("weight"))


def mix(sizes: DataFrame, plan: list[dict], seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the chosen documents; ``repeats`` is 1 to the source's cap.

    Each source comes within half a document of its need. Ties of the ranking value go by ``doc_id``.
    """
    spark = sizes.sparkSession
    shares, expected = _shared(sizes, plan), _expected()
    base = F.floor(expected + F.lit(1e-9)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    odds = lambda p: p / (1 - p)
    p, mean = F.col("_p"), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("mean")))
    ranked = (
        sizes.join(shares.drop("available"), "source")
        .withColumn("_base", base)
        .withColumn("_p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), expected - F.col("_base"))))
        .withColumn("_free", F.col("_base") < F.col("max_repeats"))
        .withColumn("_q", odds(u) / odds(p))
        .withColumn("_bin", F.floor(F.col("_q") * odds(mean) / (1 + F.col("_q") * odds(mean)) * BINS))
    )
    # tokens beyond the certain copies, by bin; then the bin of each source in which it is full
    sums = ranked.groupBy("source", "need", F.when(F.col("_free"), F.col("_bin")).alias("_bin")).agg(F.sum("n_tokens").alias("t"), F.sum(F.col("_base") * F.col("n_tokens")).alias("certain"))
    w = Window.partitionBy("source")
    upto = w.orderBy(F.asc_nulls_last("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sums.withColumn("_certain", F.sum("certain").over(w)).where(F.col("_bin").isNotNull()).withColumn("_to", F.sum("t").over(upto))
    full = filled.where((F.col("_certain") + F.col("_to") >= F.col("need")) & (F.col("_certain") + F.col("_to") - F.col("t") < F.col("need")))
    edges = {r["source"]: r for r in full.select("source", "_bin", (F.col("need") - F.col("_certain") - F.col("_to") + F.col("t")).alias("left")).collect()}
    none = filled.groupBy("source").agg((F.max("need") <= F.max("_certain")).alias("done")).collect()
    rows = [(s, int(e["_bin"]), float(e["left"])) for s, e in edges.items()] + [(r["source"], -1 if r["done"] else BINS + 1, 0.0) for r in none if r["source"] not in edges]
    edge = F.broadcast(spark.createDataFrame(rows, "source string, _edge long, _left double"))
    placed = ranked.join(edge, "source", "left")
    inside = Window.partitionBy("source").orderBy("_q", "doc_id")
    last = placed.where(F.col("_free") & (F.col("_bin") == F.col("_edge"))).withColumn("_sum", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = last.withColumn("_more", (F.col("_sum") - F.col("n_tokens") / 2 <= F.col("_left")).cast("long")).drop("_sum")
    rest = placed.where(~(F.col("_free") & F.coalesce(F.col("_bin") == F.col("_edge"), F.lit(False))))
    rest = rest.withColumn("_more", F.coalesce((F.col("_free") & (F.col("_bin") < F.col("_edge"))).cast("long"), F.lit(0)))
    chosen = rest.unionByName(last).withColumn("repeats", F.col("_base") + F.col("_more"))
    return chosen.where(F.col("repeats") > 0).select("doc_id", "source", "n_tokens", "repeats")


def inclusion(sizes: DataFrame, plan: list[dict], chosen: DataFrame) -> DataFrame:
    """(source, weight_from, documents, expected_copies, copies): how often documents of like weight were to be and are chosen.

    Classes are half powers of two of the weight; sources without documents give none.
    """
    step = F.floor(F.log2("weight") * 2)
    both = sizes.where(F.col("weight") > 0).join(_shared(sizes, plan).drop("available"), "source").select("doc_id", "source", F.pow(F.lit(2.0), step / 2).alias("weight_from"), _expected().alias("_e"))
    got = both.join(chosen.select("doc_id", "repeats"), "doc_id", "left")
    return got.groupBy("source", "weight_from").agg(F.count(F.lit(1)).alias("documents"), F.sum("_e").alias("expected_copies"), F.coalesce(F.sum("repeats"), F.lit(0)).alias("copies"))


def shares(chosen: DataFrame, plan: list[dict]) -> DataFrame:
    """Target and actual share, tokens, documents and copies of each listed source, those without documents included."""
    targets = chosen.sparkSession.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["available"]) for p in plan], "source string, target_share double, max_repeats int, available_tokens long")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("copies"))
    both = F.broadcast(targets).join(got, "source", "left").na.fill(0, ["tokens", "documents", "copies"])
    return both.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(1)))
