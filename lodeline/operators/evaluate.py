"""TREC runs, ranking metrics, run statistics and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUT = 10


def trec_rows(ranked: DataFrame, tag: str) -> DataFrame:
    """``line``: qid Q0 id rank score tag; the score is n - rank + 1."""
    n = F.count("*").over(Window.partitionBy("qid"))
    return ranked.select("qid", "rank", F.format_string("%s Q0 %s %d %.12f %s", F.col("qid").cast("string"), F.col("doc").cast("string"), F.col("rank").cast("int"), (n - F.col("rank") + 1).cast("double"), F.lit(tag)).alias("line"))


def parse_trec(lines: DataFrame) -> DataFrame:
    """``qid, doc, rank, score, tag, ok`` of text lines."""
    p = F.split(F.col("line"), " ")
    ok = (F.size(p) == 6) & (p[1] == "Q0") & p[0].rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$") & p[2].rlike(r"^[1-9][0-9]*$")
    return lines.select(p[0].alias("qid"), p[2].alias("doc"), F.try_to_number(p[3], F.lit("9999999999")).cast("int").alias("rank"), p[4].cast("double").alias("score"), p[5].alias("tag"), ok.alias("ok"))


def trec_violations(run: DataFrame, most: int = 1_000) -> DataFrame:
    """``qid, rule, n`` of rows that break the format: malformed, repeated ids, ranks with gaps, too many rows."""
    q = Window.partitionBy("qid")
    d = run.withColumn("place", F.row_number().over(q.orderBy("rank", "doc"))).withColumn("copies", F.count("*").over(Window.partitionBy("qid", "doc"))).withColumn("rows", F.count("*").over(q))
    rules = F.array_compact(
        F.array(
            F.when(~F.col("ok"), F.lit("malformed")),
            F.when(F.col("copies") > 1, F.lit("repeated id")),
            F.when(F.coalesce(F.col("rank"), F.lit(-1)) != F.col("place"), F.lit("rank not contiguous")),
            F.when(F.col("rows") > most, F.lit("too many rows")),
        )
    )
    return d.select("qid", F.explode(rules).alias("rule")).groupBy("qid", "rule").agg(F.count("*").alias("n"))


def metrics(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (100, 1_000)) -> DataFrame:
    """``qid, ndcg_10, precision_10, top_1, mrr, recall_<depth>...`` for every judged query. qrels: ``qid, doc, grade``."""
    judged = qrels.filter(F.col("grade") > 0)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = judged.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "doc")))
    best = ideal.groupBy("qid").agg(F.sum(F.when(F.col("n") <= CUT, gain / F.log2(F.col("n") + 1))).alias("idcg"), F.count("*").alias("relevant"))
    hits = run.select("qid", "doc", "rank").join(judged.select("qid", "doc", "grade"), ["qid", "doc"])
    got = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= CUT, gain / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.count_if(F.col("rank") <= CUT).alias("hits"),
        F.max(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("top"),
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= d).alias(f"r{d}") for d in depths],
    )
    j = best.join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "qid",
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg_10"),
        zero(F.col("hits") / F.lit(float(CUT))).alias("precision_10"),
        zero(F.col("top").cast("double")).alias("top_1"),
        zero(1.0 / F.col("first")).alias("mrr"),
        *[zero(F.col(f"r{d}") / F.col("relevant")).alias(f"recall_{d}") for d in depths],
    )


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in per_query.columns if c != "qid"])


def delta(off: DataFrame, on: DataFrame, least: float = 0.0) -> DataFrame:
    """``metric, off, on, delta, passed`` of two rows of means; the gate asks for a gain of NDCG@10 of at least ``least``."""
    names = [c for c in off.columns if c != "queries"]
    long = lambda d, n: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in names])).alias("m")).select("m.metric", F.col("m.v").alias(n))
    j = long(off, "off").join(long(on, "on"), "metric").withColumn("delta", F.round(F.col("on") - F.col("off"), 6))
    return j.withColumn("passed", (F.col("metric") != "ndcg_10") | ((F.col("delta") > 0) & (F.col("delta") >= least)))


def run_statistics(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """Totals of a run against its baseline: queries, rows, rows and queries with novel candidates, novel among the first ten, changed heads."""
    b = baseline.select("qid", "doc", F.col("rank").alias("base_rank"))
    j = run.select("qid", "doc", "rank").join(b, ["qid", "doc"], "left")
    novel = F.col("base_rank").isNull()
    return j.agg(
        F.countDistinct("qid").alias("queries"),
        F.count("*").alias("rows"),
        F.count_if(novel).alias("novel_rows"),
        F.countDistinct(F.when(novel, F.col("qid"))).alias("queries_with_novel"),
        F.count_if(novel & (F.col("rank") <= CUT)).alias("novel_in_top_10"),
        F.count_if((F.col("rank") == 1) & (F.coalesce(F.col("base_rank"), F.lit(0)) != 1)).alias("changed_first"),
    )


def generation_statistics(queries: DataFrame, baseline: DataFrame, seeds: DataFrame, anchors: DataFrame, bridges: DataFrame, bridge_hits: DataFrame, paths: DataFrame, run: DataFrame) -> DataFrame:
    """The 14 totals of a run with graph candidates, as one row.

    queries: ``qid``; baseline: ``qid, doc``; seeds: baseline rows known to the graph; anchors: ``qid, priority`` (0 exact, 1 duty, 2 consensus);
    bridges: ``qid``; bridge_hits: ``qid, doc``; paths: ``qid``; run: ``qid`` with ``graph_rank``, ``base_rank`` (null where a list doesn't hold the row).
    """
    per = queries.select("qid").distinct()
    count = lambda d, name, keep=None: d.groupBy("qid").agg((F.count("*") if keep is None else F.count_if(keep)).alias(name))
    graph_row = F.col("graph_rank").isNotNull()
    parts = [
        count(baseline, "baseline_rows"), count(seeds, "graph_covered_seed_rows"), count(anchors, "a_any"), count(anchors, "a_exact", F.col("priority") == 0), count(anchors, "a_duty", F.col("priority") == 1),
        count(anchors, "a_consensus", F.col("priority") == 2), count(run, "graph_candidate_rows", graph_row), count(run, "novel_graph_candidate_rows", graph_row & F.col("base_rank").isNull()), count(bridges, "bridge_terms"),
        count(bridge_hits, "bridge_retrieval_rows"), count(paths, "graph_paths"),
    ]
    for p in parts:
        per = per.join(p, "qid", "left")
    per = per.na.fill(0)
    sums = ["baseline_rows", "graph_covered_seed_rows", "graph_candidate_rows", "novel_graph_candidate_rows", "bridge_terms", "bridge_retrieval_rows", "graph_paths"]
    having = {"queries_with_any_anchors": "a_any", "queries_with_query_exact_anchors": "a_exact", "queries_with_duty_filter_anchors": "a_duty", "queries_with_consensus_anchors": "a_consensus", "queries_with_graph_candidates": "graph_candidate_rows", "queries_with_novel_graph_candidates": "novel_graph_candidate_rows"}
    return per.agg(F.count("*").alias("query_count"), *[F.sum(c).alias(c) for c in sums], *[F.count_if(F.col(c) > 0).alias(n) for n, c in having.items()])


def coverage(queries: DataFrame, run: DataFrame) -> DataFrame:
    """Queries without a result."""
    return queries.select("qid").distinct().join(run.select("qid").distinct(), "qid", "left_anti")
