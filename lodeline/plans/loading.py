"""Queries of load checks, statistics and small rules, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.functions import times, vectors
from lodeline.operators import dense, engine, extraction, graph, loads, taxonomy
from lodeline.plans import retrieval as R
from lodeline.runtime import enough_tasks, materialize, settled, table


def _clean(c):
    """Clean form of ASCII names: lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(c, " +", " ")))


def job_order_breaches(spark: SparkSession, sf: str) -> DataFrame:
    return loads.job_order_breaches(table(spark, sf, "vectors").select("job_index", "job_id"), "job_index", "job_id")


def job_order_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the vectors against that of the postings' rows."""
    v = table(spark, sf, "vectors").filter("job_index is not null").groupBy("job_index").agg(F.min("job_id").alias("job_id"))
    j = table(spark, sf, "jobs").select(F.col("source_row").cast("bigint").alias("job_index"), "job_id")
    return loads.order_differences(v, j, "job_index", "job_id")


def graph_load_breaches(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    jobs = p.select(F.col("p_brand").alias("skill"), (F.col("p_partkey") % 50).cast("string").alias("job_id"))
    duties = p.select(F.lower("p_type").alias("duty"), F.lower("p_brand").alias("skill"), (F.col("p_size") % 3).cast("bigint").alias("support"), (F.col("p_size") / 40).alias("weight"))
    relations = p.select(F.lower("p_brand").alias("source"), F.lower(F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("target"), (F.col("p_size") / 50).alias("weight"))
    return loads.graph_breaches(jobs, duties, relations, _clean)


def correction_breaches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "part").select(F.when(F.col("p_size") % 7 == 0, F.col("p_type")).otherwise(F.lower("p_type")).alias("source"), F.when(F.col("p_size") % 5 == 0, F.lower("p_type")).otherwise(F.lower("p_name")).alias("target")).distinct()
    return loads.correction_breaches(c, _clean)


def evidence_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """Stored evidence of the postings, every eleventh with the hash of another text, every thirteenth with a span that isn't in its text."""
    j = table(spark, sf, "jobs").filter("description is not null").select("job_id", F.col("description").alias("source_text"), F.col("source_modified_at").alias("updated"), F.col("job_id").cast("bigint").alias("k"))
    hashed = F.sha2(F.when(F.col("k") % 11 == 0, F.concat("source_text", F.lit("x"))).otherwise(F.col("source_text")), 256)
    e = j.withColumn("source_text_sha256", hashed).withColumn("record_id", F.sha2(F.concat_ws("\x00", "job_id", "source_text_sha256"), 256))
    span = F.when(F.col("k") % 13 == 0, F.concat(F.lit("~~"), F.col("source_text"))).otherwise(F.col("source_text"))
    e = e.withColumn("skills", F.array(F.struct(F.substring("source_text", 1, 1).alias("surface"), span.alias("evidence_span"))))
    return loads.evidence_breaches(e, F.lit("2026-05-01").cast("timestamp_ntz")).groupBy("rule").agg(F.count("*").alias("n"))


def rejection_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("skill_rejection_count"), F.col("l_quantity").cast("bigint").alias("input_tokens"))
    return loads.total_differences(o, {"skill_rejection_count": 1, "input_tokens": 2}).select("name", "stated", "found")


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "embedding_shards").select(F.col("vectors_path").alias("path"), "row_start")
    return loads.unreachable(s.filter("row_start % 80 <> 0").select("path"), s.filter("row_start % 120 <> 40").select("path"))


def shard_breaches(spark: SparkSession, sf: str) -> DataFrame:
    return loads.shard_breaches(table(spark, sf, "vectors"), table(spark, sf, "embedding_shards"), 1024)


def visible_postings(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "jobs_raw").select("source_row", F.trim("是否公開").alias("visible"))
    return loads.visible_only(r.filter("visible in ('0', '1')"), "visible").select("source_row")


def eligible_counts(spark: SparkSession, sf: str) -> DataFrame:
    return loads.eligible_counts(R.eligible_universe(spark, sf))


def taxonomy_children_of_root(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.children(table(spark, sf, "duty_taxonomy"), [])


def optional_lanes_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events as lanes: their scores fall or not, and an optional lane that breaks its contract is empty."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("qid"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("lane"), F.lit(False).alias("required"), F.col("event_id").cast("string").alias("doc"), "value", "user_id")
    w = R.Window.partitionBy("qid", "lane").orderBy(F.col("value").desc(), "doc")
    lanes = e.withColumn("rank", F.row_number().over(w)).withColumn("score", F.when((F.col("user_id") % 3 == 0) & (F.col("rank") == 2), F.col("value") + 1_000).otherwise(F.col("value")))
    kept, failed = engine.lanes_kept(lanes.select("qid", "lane", "required", "doc", "score", "rank"))
    return kept.groupBy("qid", "lane").agg(F.count("*").alias("n")).unionByName(failed.select("qid", "lane", F.lit(0).cast("bigint").alias("n")))


def required_missing(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderpriority") == "1-URGENT").alias("required"))
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc"))
    return engine.required_missing(o, c).groupBy("doc").agg(F.count("*").alias("n"))


def filter_statuses(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(engine.filter_status(F.col("o_totalprice") > 100_000, F.col("o_orderstatus") == "F").alias("status"))
    return o.groupBy("status").agg(F.count("*").alias("n"))


def epoch_milliseconds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", times.epoch_ms(F.col("ts")).alias("ms"))


def encoded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic stand-in encoder: lengths and counts of letters, at length one."""

    def client(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), t.count("a"), t.count("e"), 1.0] for t in texts])

    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc"), F.lower("n_name").alias("text"))
    e = dense.encode(n, client)
    return e.select("doc", F.posexplode(vectors.prefix_unit(F.col("vec"), 3)).alias("pos", "v")).select("doc", "pos", F.round("v", 6).alias("v"))


def request_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of a request once each, in the order given."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o"))
    return o.select("o_custkey", F.array_join(F.array_distinct(F.transform("o", lambda x: x["o_orderpriority"])), ",").alias("codes"))


def evidence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of graph candidates with up to three spans of their relation, a row for each path."""
    base, anchors, relations, search = R._search(spark, sf)
    b = settled(graph.bridges(anchors, relations).select("qid", "bridge"))
    spans = R._relations(spark, sf).select("source", "type", "target", F.col("record").cast("string").alias("span"))
    t = graph.path_traces(graph.anchor_edges(anchors, relations).join(b.withColumnRenamed("bridge", "related"), ["qid", "related"], "left_semi"), search(b), spans)
    return t.select("qid", "doc", F.explode("paths").alias("p")).select("qid", "doc", "p.n", "p.anchor", "p.related", F.array_join("p.spans", ",").alias("spans"))


def generation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from lodeline.operators import evaluate

    base, anchors, relations, search = R._search(spark, sf)
    b = settled(graph.bridges(anchors, relations))
    hits = materialize(search(b.select("qid", "bridge")))
    edges = graph.anchor_edges(anchors, relations).join(b.select("qid", F.col("bridge").alias("related")), ["qid", "related"], "left_semi")
    known = R._lines(spark, sf).select(F.col("record").alias("doc")).distinct()
    run = graph.fuse(base, graph.graph_ranks(hits.join(b, ["qid", "bridge"])))
    seeds = graph._first(base.join(known, "doc", "left_semi"), ["qid"], [F.col("rank")], graph.SEED_JOBS)
    return evaluate.generation_statistics(R._graph_queries(spark), base, seeds, anchors, b, hits, edges.select("qid", "related").join(hits.select("qid", F.col("bridge").alias("related"), "doc"), ["qid", "related"]), run)


def audit_trace_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The results of the audit traces, read back from their JSON."""
    kind = "struct<results:array<struct<position:int,id:string,best_rank:int,contribution:double,freshness:double,future:boolean,evidence:array<struct<lane:string,rank:int,score:double>>>>,lanes:array<struct<lane:string,status:string>>>"
    t = R.audit_trace_json(spark, sf).select("qid", F.from_json("trace", kind).alias("t"))
    return t.select("qid", F.size("t.lanes").alias("lanes_off"), F.explode("t.results").alias("r")).select("qid", "lanes_off", "r.position", "r.id", "r.best_rank", "r.contribution", F.round("r.freshness", 6).alias("freshness"), "r.future", F.size("r.evidence").alias("n_evidence"))


def serving_prefix_half(spark: SparkSession, sf: str) -> DataFrame:
    v = R.serving_vectors_half(spark, sf)
    return v.select("doc", F.posexplode("vec").alias("pos", "v")).select("doc", "pos", F.col("v").cast("double").alias("v"))


def rejected_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Validation of evidence of which every third span isn't in its text: the skill and its relation are rejected."""
    o = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_name").alias("source_text"), "p_partkey")
    words = F.split("source_text", " ")
    bad = F.col("p_partkey") % 3 == 0
    skill = lambda i, broken: F.struct(F.lower(words[i]).alias("canonical_name"), words[i].alias("surface"), F.lit("word").alias("category"), F.when(broken, F.concat(F.lit("not "), words[i])).otherwise(F.col("source_text")).alias("evidence_span"))
    relation = F.struct(F.lower(words[0]).alias("source"), F.lit("USED_WITH").alias("type"), F.lower(words[1]).alias("target"), F.col("source_text").alias("evidence_span"))
    e = o.filter(F.size(words) >= 2).select("record_id", "source_text", F.array(skill(0, F.lit(False)), skill(1, bad)).alias("skills"), F.array(relation).alias("relations"))
    return extraction.validated(e).select("record_id", F.size("skills").alias("n_skills"), F.size("relations").alias("n_relations"), "skill_rejection_count", "relation_rejection_count")


def code_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison form of names by the Arrow function."""
    p = enough_tasks(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("　"), "p_brand").alias("t")))
    return p.select("p_partkey", X.canonical_code("t").alias("form"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            job_order_breaches, job_order_differences, graph_load_breaches, correction_breaches, evidence_breaches, rejection_totals, reachability, shard_breaches, visible_postings, eligible_counts,
            taxonomy_children_of_root, optional_lanes_kept, required_missing, filter_statuses, epoch_milliseconds, encoded_texts, request_codes, evidence_spans, generation_statistics, audit_trace_rows,
            serving_prefix_half, rejected_evidence, code_forms,
        )
    }


def oracle_sql() -> dict[str, str]:
    clean = "lower(trim(regexp_replace({}, ' +', ' ', 'g')))"
    unclean = lambda c: f"(coalesce({c}, '') = '' OR {clean.format(c)} <> {c})"
    fresh = "CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 0.0 ELSE greatest(0.0, 1 - (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 86400000000.0 / 180) END"
    graph_sql = f"WITH {R.GRAPH}, {R.BASE}, {R.ANCHORS}, {R.HITS}"
    return {
        "job_order_breaches": """SELECT 'unsafe id' AS rule, coalesce(job_id, '') AS value FROM vectors WHERE NOT regexp_full_match(coalesce(job_id, ''), '[0-9]+') UNION ALL SELECT 'repeated id', job_id FROM vectors GROUP BY job_id HAVING count(*) > 1
          UNION ALL SELECT 'repeated place', job_index::VARCHAR FROM vectors GROUP BY job_index HAVING count(*) > 1 UNION ALL SELECT 'gaps', (max(job_index) + 1 - count(DISTINCT job_index))::VARCHAR FROM vectors HAVING max(job_index) + 1 <> count(DISTINCT job_index)""",
        "job_order_differences": "SELECT job_index, a.job_id AS first, b.job_id AS second FROM (SELECT job_index, min(job_id) AS job_id FROM vectors WHERE job_index IS NOT NULL GROUP BY 1) a FULL OUTER JOIN (SELECT source_row::BIGINT AS job_index, job_id FROM jobs) b USING (job_index) WHERE a.job_id IS DISTINCT FROM b.job_id",
        "graph_load_breaches": f"""WITH j AS (SELECT p_brand AS skill, (p_partkey % 50)::VARCHAR AS job_id FROM part), d AS (SELECT lower(p_type) AS duty, lower(p_brand) AS skill, p_size % 3 AS support, p_size / 40.0 AS weight FROM part),
          r AS (SELECT lower(p_brand) AS source, lower(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END) AS target, p_size / 50.0 AS weight FROM part),
          x AS (SELECT 'job skills' AS part, 'unclean text' AS rule, count(*) AS n FROM j WHERE {unclean('skill')} UNION ALL SELECT 'job skills', 'unsafe id', count(*) FROM j WHERE NOT regexp_full_match(job_id, '0*[1-9][0-9]*')
          UNION ALL SELECT 'duty skills', 'unclean text', count(*) FROM d WHERE {unclean('duty')} OR {unclean('skill')} UNION ALL SELECT 'duty skills', 'weight out of range', count(*) FROM d WHERE weight <= 0 OR weight > 1 UNION ALL SELECT 'duty skills', 'support below one', count(*) FROM d WHERE support < 1
          UNION ALL SELECT 'relations', 'unclean text', count(*) FROM r WHERE {unclean('source')} OR {unclean('target')} UNION ALL SELECT 'relations', 'weight out of range', count(*) FROM r WHERE weight <= 0 OR weight > 1 UNION ALL SELECT 'relations', 'own end', count(*) FROM r WHERE source = target)
          SELECT part, rule, n FROM x WHERE n > 0""",
        "correction_breaches": f"""WITH c AS (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN p_type ELSE lower(p_type) END AS source, CASE WHEN p_size % 5 = 0 THEN lower(p_type) ELSE lower(p_name) END AS target FROM part)
          SELECT source, target, 'not canonical' AS rule FROM c WHERE {unclean('source')} OR {unclean('target')} UNION ALL SELECT source, target, 'changes nothing' FROM c WHERE source = target""",
        "evidence_breaches": """WITH j AS (SELECT job_id, description AS t, source_modified_at AS u, job_id::BIGINT AS k FROM jobs WHERE description IS NOT NULL)
          SELECT rule, count(*) AS n FROM (SELECT 'other hash' AS rule FROM j WHERE k % 11 = 0 UNION ALL SELECT 'after cutoff' FROM j WHERE u >= TIMESTAMP '2026-05-01' OR u IS NULL UNION ALL SELECT 'span outside text' FROM j WHERE k % 13 = 0) GROUP BY rule""",
        "rejection_totals": "SELECT 'skill_rejection_count' AS name, 1::BIGINT AS stated, sum(l_linenumber)::BIGINT AS found FROM lineitem UNION ALL SELECT 'input_tokens', 2, sum(l_quantity::BIGINT)::BIGINT FROM lineitem",
        "reachability": "SELECT vectors_path AS path, CASE WHEN row_start % 80 <> 0 THEN 'not in the inventory' ELSE 'not reachable' END AS side FROM embedding_shards WHERE (row_start % 80 <> 0) <> (row_start % 120 <> 40)",
        "shard_breaches": """WITH v AS (SELECT job_index, count(DISTINCT embedding::VARCHAR) AS kinds, max((coalesce(len(embedding), -1) <> 1024)::INT) AS other FROM vectors GROUP BY 1),
          p AS (SELECT vectors_path, row_start, row_end, count(job_index) AS held, count(*) FILTER (kinds > 1) AS several, coalesce(sum(other), 0) AS other FROM embedding_shards LEFT JOIN v ON job_index >= row_start AND job_index < row_end GROUP BY ALL)
          SELECT vectors_path, rule, n FROM (SELECT vectors_path, 'no vector' AS rule, (row_end - row_start - held)::BIGINT AS n FROM p UNION ALL SELECT vectors_path, 'several vectors', several FROM p UNION ALL SELECT vectors_path, 'other length', other::BIGINT FROM p) WHERE n > 0""",
        "visible_postings": "SELECT source_row FROM jobs_raw WHERE trim(\"是否公開\") = '1'",
        "eligible_counts": f"SELECT qid, count(*) AS n FROM ({R.oracle_sql()['eligible_universe']}) GROUP BY qid",
        "taxonomy_children_of_root": """WITH p AS (SELECT codeno AS code, list_reverse(list_filter([trim(codenamea), trim(codenameb), trim(codenamec)], lambda x: x <> '')) AS raw FROM duty_taxonomy),
          d AS (SELECT code, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS path FROM p), n AS (SELECT path[1] AS path, CASE WHEN len(path) = 1 THEN code END AS code FROM d WHERE len(path) > 0),
          h AS (SELECT path, list(DISTINCT code) FILTER (code IS NOT NULL) AS codes, bool_or(code IS NULL) AS has_children FROM n GROUP BY path) SELECT path, unnest(CASE WHEN codes IS NULL THEN [NULL] ELSE codes END) AS code, has_children FROM h""",
        "optional_lanes_kept": "WITH g AS (SELECT event_type AS qid, 'user ' || user_id AS lane, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT qid, lane, CASE WHEN n > 200 OR (user_id % 3 = 0 AND n > 1) THEN 0 ELSE n END AS n FROM g",
        "required_missing": "SELECT o_custkey AS doc, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
        "filter_statuses": "SELECT CASE WHEN NOT o_totalprice > 100000 THEN 'not_requested' WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'unverified' END AS status, count(*) AS n FROM orders GROUP BY 1",
        "epoch_milliseconds": "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events",
        "encoded_texts": "WITH n AS (SELECT n_nationkey AS doc, lower(n_name) AS t FROM nation), v AS (SELECT doc, [length(t)::DOUBLE, length(t) - length(replace(t, 'a', '')), length(t) - length(replace(t, 'e', ''))] AS v FROM n) SELECT doc, (i - 1)::INT AS pos, round(v[i] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS v FROM v, range(1, 4) AS r(i)",
        "request_codes": "WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS codes FROM f GROUP BY 1",
        "evidence_spans": f"""{graph_sql}, p AS (SELECT ae.qid, h.doc, strength * weight / (60 + rank) AS s, rank, ae.skill, ae.related, source, type, target FROM ae JOIN hits h ON h.qid = ae.qid AND h.bridge = ae.related),
          n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY round(s, 9) DESC, rank, skill, related, source, type, target) AS n FROM p QUALIFY n <= 5),
          sp AS (SELECT source, type, target, string_agg(span, ',' ORDER BY span) AS spans FROM (SELECT * FROM (SELECT DISTINCT source, type, target, record::VARCHAR AS span FROM rel) QUALIFY row_number() OVER (PARTITION BY source, type, target ORDER BY span) <= 3) GROUP BY ALL)
          SELECT qid, doc, n::INT AS n, skill AS anchor, related, spans FROM n LEFT JOIN sp USING (source, type, target)""",
        "generation_statistics": f"""{graph_sql}, {R.FUSED}, gq2 AS (SELECT qid FROM gq), a AS (SELECT qid, count(*) AS a, count(*) FILTER (priority = 0) AS a0, count(*) FILTER (priority = 1) AS a1, count(*) FILTER (priority = 2) AS a2 FROM anchors GROUP BY qid),
          g AS (SELECT qid, count(*) AS g, count(*) FILTER (base_rank IS NULL) AS v FROM fu WHERE graph_rank IS NOT NULL GROUP BY qid)
          SELECT (SELECT count(*) FROM gq2) AS query_count, (SELECT count(*) FROM ranked) AS baseline_rows, (SELECT count(*) FROM seeds) AS graph_covered_seed_rows, (SELECT coalesce(sum(g), 0)::BIGINT FROM g) AS graph_candidate_rows, (SELECT coalesce(sum(v), 0)::BIGINT FROM g) AS novel_graph_candidate_rows,
          (SELECT count(*) FROM br) AS bridge_terms, (SELECT count(*) FROM hits) AS bridge_retrieval_rows, (SELECT count(*) FROM (SELECT DISTINCT qid, related, skill, source, type, target FROM ae) e JOIN hits h ON h.qid = e.qid AND h.bridge = e.related) AS graph_paths,
          (SELECT count(*) FROM a) AS queries_with_any_anchors, (SELECT count(*) FROM a WHERE a0 > 0) AS queries_with_query_exact_anchors, (SELECT count(*) FROM a WHERE a1 > 0) AS queries_with_duty_filter_anchors, (SELECT count(*) FROM a WHERE a2 > 0) AS queries_with_consensus_anchors,
          (SELECT count(*) FROM g WHERE g > 0) AS queries_with_graph_candidates, (SELECT count(*) FROM g WHERE v > 0) AS queries_with_novel_graph_candidates""",
        "audit_trace_rows": f"""WITH {R.LANES} c AS (SELECT qid, doc, rank, true AS required, {R.TOP_SCORE}.0 - rank AS score FROM ranked WHERE rank <= 200 UNION ALL SELECT qid, doc, graph_rank, false, {R.TOP_SCORE}.0 - graph_rank FROM gr),
          m AS (SELECT qid, doc, max(required::INT) AS incumbent, min(rank) AS best_rank, sum(CASE WHEN required THEN score ELSE 0 END) AS contribution, count(*) AS n_evidence FROM c GROUP BY ALL), f AS (SELECT m.*, {fresh} AS freshness, ts > TIMESTAMP '2024-01-20' AS future FROM m JOIN events ON doc = event_id)
          SELECT qid, 3 AS lanes_off, (row_number() OVER (PARTITION BY qid ORDER BY incumbent DESC, best_rank, round(freshness, 9) DESC, doc::VARCHAR))::INT AS position, doc::VARCHAR AS id, best_rank::INT AS best_rank, contribution::DOUBLE AS contribution, round(freshness, 6) AS freshness, future, n_evidence::INT AS n_evidence FROM f QUALIFY position <= 10""",
        "serving_prefix_half": """WITH p AS (SELECT vec_id AS doc, list_slice(embedding::DOUBLE[], 1, 16) AS v FROM embeddings), n AS (SELECT doc, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM p),
          u AS (SELECT doc, (i - 1)::INT AS pos, v[i] / n AS x FROM n, range(1, 17) AS r(i)), q AS (SELECT *, pow(2, greatest(floor(log2(greatest(abs(x), 1e-30))), -14) - 10) AS step FROM u) SELECT doc, pos, round(x / step) * step AS v FROM q""",
        "rejected_evidence": """WITH w AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part), e AS (SELECT k, lower(w[1]) AS a, lower(w[2]) AS b, k % 3 = 0 AS bad FROM w WHERE len(w) >= 2)
          SELECT k::VARCHAR AS record_id, CASE WHEN bad OR a = b THEN 1 ELSE 2 END AS n_skills, CASE WHEN bad OR a = b THEN 0 ELSE 1 END AS n_relations, CASE WHEN bad OR a = b THEN 1 ELSE 0 END AS skill_rejection_count, CASE WHEN bad OR a = b THEN 1 ELSE 0 END AS relation_rejection_count FROM e""",
        "code_forms": "SELECT p_partkey, lower(p_name || ' ' || p_brand) AS form FROM part",
    }
