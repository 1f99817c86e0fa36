"""Lane merge, revalidation, audit traces, lane contracts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.times import freshness

MAX_LANE_ROWS = 200
MOST_RESULTS = 10


def lane_violations(lanes: DataFrame) -> DataFrame:
    """``qid, lane, doc, rule``: too many rows, repeated or unsafe ids, scores that aren't finite or rise, ranks with gaps."""
    lane = Window.partitionBy("qid", "lane")
    d = lanes.withColumn("n", F.count("*").over(lane)).withColumn("copies", F.count("*").over(Window.partitionBy("qid", "lane", "doc")))
    order = lane.orderBy("rank", F.col("doc"))
    d = d.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("score").over(order))
    rules = F.array_compact(
        F.array(
            F.when(F.col("n") > MAX_LANE_ROWS, F.lit("too many rows")),
            F.when(F.col("copies") > 1, F.lit("repeated id")),
            F.when(~F.col("doc").cast("string").rlike(r"^[0-9]+$"), F.lit("unsafe id")),
            F.when(F.isnan("score") | (F.abs("score") == float("inf")), F.lit("score not finite")),
            F.when(F.col("rank") != F.col("place"), F.lit("rank not contiguous")),
            F.when(F.col("score") > F.col("before"), F.lit("score rises")),
        )
    )
    return d.select("qid", "lane", "doc", F.explode(rules).alias("rule"))


def lanes_kept(lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lanes ``qid, lane, required, ...`` after their contract, and ``qid, lane, status`` of those that failed: an optional lane in breach is empty for its query,
    a required one is an error when the plan runs."""
    broken = lane_violations(lanes).select("qid", "lane").distinct().withColumn("_failed", F.lit(True))
    checked = lanes.join(broken, ["qid", "lane"], "left")
    guard = F.when(F.col("_failed") & F.col("required"), F.raise_error(F.concat(F.lit("a required lane failed: "), F.col("lane"))).cast("boolean")).otherwise(F.col("_failed"))
    checked = checked.withColumn("_failed", guard)
    return checked.filter(F.col("_failed").isNull()).drop("_failed"), checked.filter("_failed").select("qid", "lane", F.lit("shadow_lane_failed").alias("status")).distinct()


def collected(required: Callable[[], DataFrame], optional: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, dict[str, str]]:
    """The union of the lanes' rows and the optional lanes that couldn't be planned; if the required one can't, its error goes on."""
    rows, failed = required(), {}
    for name, lane in optional.items():
        try:
            rows = rows.unionByName(lane())
        except Exception as e:  # noqa: BLE001
            failed[name] = f"shadow_lane_failed: {type(e).__name__}"
    return rows, failed


def required_missing(candidates: DataFrame, metadata: DataFrame) -> DataFrame:
    """Candidates of required lanes that have no metadata."""
    return candidates.filter("required").join(metadata.select("doc"), "doc", "left_anti")


def revalidate(candidates: DataFrame, metadata: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds ``violation`` (null if the row passes): hard filters again on metadata, at millisecond precision.

    candidates: ``qid, lane, required, doc, score, rank``; metadata: ``doc, location_codes, duty_codes, updated_ms``;
    requests: ``qid, locations, duties, minimum_ms`` by code, empty arrays for no restriction.
    """
    met = candidates.join(metadata, "doc").join(requests, "qid")
    return met.withColumn(
        "violation",
        F.when(F.col("updated_ms") < F.col("minimum_ms"), F.lit("stale"))
        .when((F.size("locations") > 0) & ~F.arrays_overlap("locations", "location_codes"), F.lit("location"))
        .when((F.size("duties") > 0) & ~F.arrays_overlap("duties", "duty_codes"), F.lit("duty")),
    )


def enforce(checked: DataFrame) -> DataFrame:
    """Rows of optional lanes that violate a filter are dropped; one on a required lane is an error when the plan runs."""
    guard = F.when(F.col("required") & F.col("violation").isNotNull(), F.raise_error(F.concat(F.lit("required lane violates filter: "), F.col("violation"))).cast("string")).otherwise(F.col("violation"))
    return checked.withColumn("violation", guard).filter(F.col("violation").isNull()).drop("violation")


def merge(candidates: DataFrame, metadata: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """``qid, doc, position, best_rank, contribution, freshness, future, evidence``.

    The incumbent lane alone gives scores and comes first; other lanes only fill the tail, by best rank, freshness and id. limit: 1 to 10.
    """
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must lie between 1 and {MOST_RESULTS}")
    m = candidates.groupBy("qid", "doc").agg(
        F.max(F.col("required").cast("int")).alias("incumbent"),
        F.min("rank").alias("best_rank"),
        F.sum(F.when(F.col("required"), F.col("score")).otherwise(0.0)).alias("contribution"),
        F.array_sort(F.collect_list(F.struct("lane", "rank", "score"))).alias("evidence"),
    )
    m = m.join(metadata.select("doc", "updated"), "doc").withColumn("freshness", freshness(F.col("updated"), as_of)).withColumn("future", F.col("updated").cast("timestamp") > as_of.cast("timestamp"))
    w = Window.partitionBy("qid").orderBy(F.col("incumbent").desc(), "best_rank", F.round("freshness", 9).desc(), F.col("doc").cast("string"))
    return m.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def ordered_union(lanes: DataFrame) -> DataFrame:
    """``qid, doc, place``: ids of all lanes once, in the order of lanes and ranks."""
    first = lanes.groupBy("qid", "doc").agg(F.min(F.struct("lane_order", "rank")).alias("f"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("f"))).select("qid", "doc", "place")


def filter_status(requested: Column, verified: Column) -> Column:
    return F.when(~requested, F.lit("not_requested")).when(verified, F.lit("verified")).otherwise(F.lit("unverified"))


def audit_trace(merged: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """``qid, trace``: one JSON object for each query with results, evidence and the lanes that are off."""
    off = F.array(*[F.struct(F.lit(x).alias("lane"), F.lit("disabled").alias("status")) for x in (disabled or ["reranker", "ltr", "guardrail"])])
    rows = F.struct("position", F.col("doc").cast("string").alias("id"), "best_rank", F.round("contribution", 8).alias("contribution"), F.round("freshness", 8).alias("freshness"), "future", "evidence")
    return merged.groupBy("qid").agg(F.to_json(F.struct(F.array_sort(F.collect_list(rows)).alias("results"), off.alias("lanes"))).alias("trace"))


def rewrite(text: Column, corrections: Column) -> Column:
    """Texts to search: the original, then the corrected one if it differs. corrections: map of canonical strings."""
    whole = F.element_at(corrections, text)
    words = F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.element_at(corrections, t), t)), " ")
    return F.array_distinct(F.array(text, F.coalesce(whole, words)))


def mine_corrections(pairs: DataFrame, minimum: int = 2) -> DataFrame:
    """``source, target, support`` from ``surface, target``: differing pairs with enough support whose surface has one target only (before the threshold)."""
    counts = pairs.filter(F.col("surface") != F.col("target")).groupBy("surface", "target").agg(F.count("*").alias("support"))
    single = counts.groupBy("surface").agg(F.count("*").alias("targets"), F.first("target").alias("target"), F.first("support").alias("support"))
    return single.filter((F.col("targets") == 1) & (F.col("support") >= minimum)).select(F.col("surface").alias("source"), "target", "support")


def with_details(ranked: DataFrame, details: DataFrame) -> DataFrame:
    """Ranked rows with their details and, for each query, how many have none; a query without any detail is an error when the plan runs."""
    d = ranked.join(details.withColumn("_found", F.lit(True)), "doc", "left")
    q = Window.partitionBy("qid")
    d = d.withColumn("missing", F.count_if(F.col("_found").isNull()).over(q)).withColumn("_n", F.count("*").over(q))
    guard = F.when(F.col("missing") == F.col("_n"), F.raise_error(F.lit("no details at all")).cast("bigint")).otherwise(F.col("missing"))
    return d.withColumn("missing", guard).drop("_found", "_n")
