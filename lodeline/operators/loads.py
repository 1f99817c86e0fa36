"""Checks of what a search service loads: job orders, graph tables, corrections, evidence, reachable files, vector shards.

Checks are queries that give the rows in breach, so that they run distributed and can be read; ``require_none`` turns any row into an error when a
load has to stop.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_ID = r"^[0-9]+$"


def require_none(breaches: DataFrame, what: str, shown: int = 5) -> None:
    """An error that names some of the breaches, if there are any."""
    rows = breaches.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def _rules(**rules: Column) -> Column:
    """The names of the rules that a row breaks (underscores become blanks)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name.replace("_", " "))) for name, broken in rules.items()]))


def job_order_breaches(order: DataFrame, index: str, key: str) -> DataFrame:
    """``rule, value`` of a job order: ids that aren't decimal, ids and places that occur twice, gaps in the places (from 0)."""
    unsafe = order.filter(~F.coalesce(F.col(key), F.lit("")).rlike(SAFE_ID)).select(F.lit("unsafe id").alias("rule"), F.coalesce(F.col(key), F.lit("")).alias("value"))
    twice = lambda c, rule: order.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("value"))
    span = order.agg(F.max(index).alias("top"), F.countDistinct(index).alias("n")).filter("top + 1 <> n").select(F.lit("gaps").alias("rule"), (F.col("top") + 1 - F.col("n")).cast("string").alias("value"))
    return unsafe.unionByName(twice(key, "repeated id")).unionByName(twice(index, "repeated place")).unionByName(span)


def order_differences(a: DataFrame, b: DataFrame, index: str, key: str) -> DataFrame:
    """``index, first, second``: places at which two orders hold different ids, or only one holds any. One row a place in each order."""
    left, right = a.select(index, F.col(key).alias("first")), b.select(index, F.col(key).alias("second"))
    return left.join(right, index, "full_outer").filter(~F.col("first").eqNullSafe(F.col("second")))


def graph_breaches(job_skills: DataFrame, duty_skills: DataFrame, relations: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """``part, rule, n`` of the three tables of a skill graph: texts that are empty or not in clean form, unsafe ids, weights outside (0, 1], supports below
    one, relations of a skill with itself, and tables without a row."""
    dirty = lambda c: (F.coalesce(F.col(c), F.lit("")) == "") | (clean(F.col(c)) != F.col(c))
    weight = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0) | (F.col("weight") > 1)
    parts = {
        "job skills": (job_skills, _rules(unclean_text=dirty("skill"), unsafe_id=~F.col("job_id").rlike(r"^0*[1-9][0-9]*$"))),
        "duty skills": (duty_skills, _rules(unclean_text=dirty("duty") | dirty("skill"), weight_out_of_range=weight, support_below_one=F.col("support") < 1)),
        "relations": (relations, _rules(unclean_text=dirty("source") | dirty("target"), weight_out_of_range=weight, own_end=F.col("source") == F.col("target"))),
    }
    out = None
    for part, (rows, rules) in parts.items():
        broken = rows.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
        empty = rows.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("empty").alias("rule"), F.lit(1).cast("bigint").alias("n"))
        both = broken.unionByName(empty).select(F.lit(part).alias("part"), "rule", "n")
        out = both if out is None else out.unionByName(both)
    return out


def correction_breaches(corrections: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """``source, target, rule``: corrections whose texts are empty or not in clean form, or that change nothing."""
    unclean = (F.coalesce(F.col("source"), F.lit("")) == "") | (F.coalesce(F.col("target"), F.lit("")) == "") | (clean(F.col("source")) != F.col("source")) | (clean(F.col("target")) != F.col("target"))
    return corrections.select("source", "target", F.explode(_rules(not_canonical=unclean, changes_nothing=F.col("source") == F.col("target"))).alias("rule"))


CORRECTION_FLAGS: Mapping[str, object] = {"complete": True, "publication_allowed": False, "source_policy": "train_jd_only", "test_jd_used": False, "uses_ground_truth": False, "uses_behavior_logs": False}
PROMOTION_FLAGS: Mapping[str, object] = {"complete": True, "publication_allowed": True, "evaluator_kind": "organizer", "significant": True, "primary_metric": "ndcg_at_10"}


def load_corrections(corrections: DataFrame, manifest: Mapping, promotion: Mapping, clean: Callable[[Column], Column]) -> DataFrame:
    """Corrections that may be served: built from training data before the cutoff, promoted on a significant official gain, every rule canonical."""
    wrong = [k for flags, given in ((CORRECTION_FLAGS, manifest), (PROMOTION_FLAGS, promotion)) for k, v in flags.items() if given.get(k) is not v and given.get(k) != v]
    if wrong:
        raise ValueError(f"flags of the corrections: {wrong}")
    if not manifest["max_source_timestamp"] < manifest["train_cutoff_exclusive"]:
        raise ValueError("corrections from after the cutoff")
    if not promotion["absolute_delta"] > 0:
        raise ValueError("no gain")
    require_none(correction_breaches(corrections, clean), "corrections")
    if corrections.isEmpty():
        raise ValueError("no corrections")
    return corrections


def evidence_breaches(evidence: DataFrame, cutoff: Column) -> DataFrame:
    """``record_id, rule`` of stored evidence ``record_id, job_id, source_text, source_text_sha256, updated, skills``: hashes and record ids that don't
    follow from the text, sources from the cutoff on, spans outside the text, records stored twice."""
    digest = F.sha2(F.coalesce("source_text", F.lit("")), 256)
    outside = F.exists("skills", lambda s: ~F.contains(F.col("source_text"), s["evidence_span"]) | ~F.contains(s["evidence_span"], s["surface"]))
    rules = _rules(other_hash=F.col("source_text_sha256") != digest, other_record_id=F.col("record_id") != F.sha2(F.concat_ws("\x00", "job_id", "source_text_sha256"), 256), after_cutoff=F.col("updated") >= cutoff, span_outside_text=outside)
    own = evidence.select("record_id", F.explode(rules).alias("rule"))
    return own.unionByName(evidence.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1").select("record_id", F.lit("stored twice").alias("rule")))


def total_differences(rows: DataFrame, stated: Mapping[str, int]) -> DataFrame:
    """``name, stated, found``: sums of columns against the totals a manifest states, where they differ."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in stated])
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(n).cast("bigint").alias("stated"), F.col(c).alias("found")) for c, n in stated.items()])
    return sums.select(F.explode(each).alias("t")).select("t.*").filter("stated <> found")


def unreachable(reachable: DataFrame, inventory: DataFrame) -> DataFrame:
    """``path, side``: files that are only reachable from the manifests, or only in the inventory."""
    a, b = reachable.select("path").distinct().withColumn("r", F.lit(True)), inventory.select("path").distinct().withColumn("i", F.lit(True))
    one = a.join(b, "path", "full_outer").filter("r is null or i is null")
    return one.select("path", F.when(F.col("i").isNull(), "not in the inventory").otherwise("not reachable").alias("side"))


def shard_breaches(vectors: DataFrame, shards: DataFrame, dim: int) -> DataFrame:
    """``vectors_path, rule, n``: places of a shard without a vector, with several different ones, or with a vector of another length.

    Vectors meet their shard by equi-join on blocks of ``row_start``'s size class, so that ranges don't cost a nested loop.
    """
    size = 1_024
    ranges = shards.filter("row_end > row_start").select("vectors_path", "row_start", "row_end", F.explode(F.sequence(F.floor(F.col("row_start") / size), F.floor((F.col("row_end") - 1) / size))).alias("block"))
    v = vectors.select("job_index", F.coalesce(F.size("embedding"), F.lit(-1)).alias("length"), F.xxhash64("embedding").alias("h"), F.floor(F.col("job_index") / size).alias("block"))
    met = ranges.join(v, "block").filter("job_index >= row_start and job_index < row_end")
    place = met.groupBy("vectors_path", "row_start", "row_end", "job_index").agg(F.countDistinct("h").alias("kinds"), F.max((F.col("length") != dim).cast("int")).alias("other"))
    per = place.groupBy("vectors_path").agg(F.count("*").alias("held"), F.count_if(F.col("kinds") > 1).alias("several"), F.sum("other").alias("other"))
    all_ = shards.select("vectors_path", "row_start", "row_end").join(per, "vectors_path", "left").na.fill(0, ["held", "several", "other"])
    counts = F.array(F.struct(F.lit("no vector").alias("rule"), (F.col("row_end") - F.col("row_start") - F.col("held")).alias("n")), F.struct(F.lit("several vectors").alias("rule"), F.col("several").alias("n")), F.struct(F.lit("other length").alias("rule"), F.col("other").cast("bigint").alias("n")))
    return all_.select("vectors_path", F.explode(counts).alias("c")).select("vectors_path", "c.rule", "c.n").filter("n > 0")


def visible_only(rows: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is 1; a flag other than 0 and 1 is an error when the plan runs."""
    known = F.when(F.col(flag).isin("0", "1"), F.col(flag)).otherwise(F.raise_error(F.concat(F.lit("unknown visibility: "), F.coalesce(F.col(flag), F.lit("null")))).cast("string"))
    return rows.withColumn(flag, known).filter(F.col(flag) == "1")


def eligible_counts(eligible: DataFrame, most: int | None = None) -> DataFrame:
    """``qid, n``: eligible documents of each request, however many; with ``most``, for a scan that can't take more, a larger number is an error when the plan runs."""
    counts = eligible.groupBy("qid").agg(F.count("*").alias("n"))
    if most is None:
        return counts
    return counts.withColumn("n", F.when(F.col("n") > most, F.raise_error(F.concat(F.lit("too many eligible documents: "), F.col("qid").cast("string"))).cast("bigint")).otherwise(F.col("n")))
