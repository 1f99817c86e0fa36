"""Queries of sampling, evaluation, audits, corrections, imports and streaming-ready aggregates, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.functions import times
from lodeline.operators import audit, engine, evaluate, extraction, sampling, taxonomy
from lodeline.runtime import enough_tasks, literal, table
from lodeline.streaming import deliveries

FIXES = {"enginer": "engineer", "acountant": "accountant", "資深": "senior", "night": "夜班"}
RULES = ["embeddings/whole-1024/shards/00000", "embeddings/whole-1024/shards/0000", "embeddings/none/"]


def query_corrections(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("surface"), F.lower("p_type").alias("target"))
    return engine.mine_corrections(p, 1)


def correction_apply(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv])
    t = table(spark, sf, "jobs").select("job_id", F.lower("title").alias("t"))
    return t.select("job_id", F.array_join(engine.rewrite(F.col("t"), m), "|").alias("texts"))


def stratified_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.hash_sample(o, "o_orderpriority", "o_orderkey", 100, "split-1").select("o_orderkey", "o_orderpriority")


def extraction_requests(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "jobs").select("job_id", F.coalesce("description", F.lit("")).alias("source_text"), "duty_minor", "source_modified_at")
    train = j.filter((F.col("source_modified_at") < F.lit("2026-05-01").cast("timestamp_ntz")) & (X.stratum_null(F.col("duty_minor")) != ""))
    h = F.sha2("source_text", 256)
    return train.select("job_id", h.alias("source_text_sha256"), F.sha2(F.concat_ws("\x00", "job_id", h), 256).alias("record_id"))


def _ranking(spark: SparkSession, sf: str, order: list) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("qid"), F.col("event_id").alias("doc"), "value", "ts")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, "doc"))).filter("rank <= 1000")


def trec_rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.trec_rows(_ranking(spark, sf, [F.col("value").desc()]), "lodeline").select("line")


def trec_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with planted faults: every 50th without tag, every 70th id with a leading zero, every 90th rank off by one."""
    r = _ranking(spark, sf, [F.col("value").desc()])
    doc = F.when(F.col("rank") % 70 == 0, F.concat(F.lit("0"), F.col("doc").cast("string"))).otherwise((F.col("doc") + 1).cast("string"))
    rank = F.when(F.col("rank") % 90 == 0, F.col("rank") + 5000).otherwise(F.col("rank"))
    line = F.concat_ws(" ", "qid", F.lit("Q0"), doc, rank.cast("string"), F.lit("1.0"), F.when(F.col("rank") % 50 != 0, F.lit("t")))
    return evaluate.trec_violations(evaluate.parse_trec(r.select(line.alias("line"))))


def _qrels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id % 7 < 3").select(F.col("event_type").alias("qid"), F.col("event_id").alias("doc"), (F.col("user_id") % 7).cast("int").alias("grade"))


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.metrics(_ranking(spark, sf, [F.col("value").desc()]), _qrels(spark, sf))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in m.columns if c != "qid"])


def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    q = _qrels(spark, sf)
    off = evaluate.mean_metrics(evaluate.metrics(_ranking(spark, sf, [F.col("value").desc()]), q))
    on = evaluate.mean_metrics(evaluate.metrics(_ranking(spark, sf, [F.col("ts").desc()]), q))
    return evaluate.delta(off, on)


def zero_result_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"))
    return evaluate.coverage(c, table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("qid")))


def staging_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "jobs_raw")
    return audit.staging_audit(r, "職缺編號", "source_row", ["職缺編號", "職務名稱"])


#: The text columns of a delivery besides those of a posting's document.
DELIVERY_COLUMNS = [text for text, _ in X.JOB_FIELDS] + ["職缺編號", "職缺最後修改時間", "工作城市編號", "職務小類編號", "是否公開"]


def null_normalise(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "jobs_raw").select(*[X.snapshot_null(F.col(c)).alias(c) for c in DELIVERY_COLUMNS])
    return r.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(DELIVERY_COLUMNS)])


def salary_casts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("s"), "p_name")
    return p.select("p_partkey", F.expr("cast(try_cast(s as decimal(12,2)) as double)").alias("price"), F.expr("try_cast(p_name as decimal(12,2)) is null").alias("not_a_number"))


def jobs_latest_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """The newest delivery of every posting, by its modification time and then its arrival."""
    t = times.parse_source(F.regexp_replace(F.trim("職缺最後修改時間"), "/", "-"))
    r = table(spark, sf, "jobs_raw").select(F.col("職缺編號").alias("job_id"), F.col("職缺最後修改時間"), "source_row")
    return audit.latest(r.withColumn("t", t), "job_id", [F.col("t"), -F.col("source_row")]).select("job_id", F.col("source_row").cast("bigint").alias("source_row"))


def snapshot_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Stored newest rows against derived ones, repeated rows counted."""
    a = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    b = table(spark, sf, "orders").filter("o_orderkey % 97 <> 0").select("o_custkey", "o_orderstatus")
    return audit.difference(a, b).groupBy("side").agg(F.count("*").alias("n"))


def row_order_digest(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return audit.order_digest(n, F.col("n_name"), F.col("n_nationkey"))


def blocked_order_digest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return audit.order_digest(o, F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"), F.col("o_orderkey"), 1_000)


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embedding_shards").select(F.col("vectors_path").alias("path"), F.sha2("vectors_path", 256).alias("sha256"), (F.col("row_end") - F.col("row_start")).alias("size_bytes"))


def inventory_rules(spark: SparkSession, sf: str) -> DataFrame:
    return audit.inventory_rules(_objects(spark, sf), literal(spark, [(r,) for r in RULES], "prefix string"))


def inventory_unused(spark: SparkSession, sf: str) -> DataFrame:
    return audit.unused_rules(_objects(spark, sf), literal(spark, [(r,) for r in RULES], "prefix string"))


def release_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.release_totals(_objects(spark, sf))


def required_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.required_artifacts(_objects(spark, sf), literal(spark, [(RULES[0],), (RULES[2],)], "prefix string")).select("path", "size_bytes")


def forbidden_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("path"))
    return extraction.forbidden_paths(o, ["red", "7"]).groupBy("path").agg(F.count("*").alias("n"))


def extracted_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A rule-based stand-in for the model: the Latin words of a description, with the sentence as evidence; then validation."""
    import re

    def client(text: str) -> dict:
        spans = [(w, s) for s in re.split(r"[。\n]", text) for w in re.findall(r"[A-Z][A-Za-z+#.]{2,}", s)]
        skills = [{"canonical_name": w.lower(), "surface": w, "category": "word", "evidence_span": s} for w, s in spans]
        return {"skills": skills, "relations": [{"source": a[0].lower(), "type": "RELATED_TO", "target": b[0].lower(), "evidence_span": a[1]} for a, b in zip(spans, spans[1:], strict=False)]}

    j = enough_tasks(table(spark, sf, "jobs").select(F.col("job_id").alias("record_id"), F.coalesce("description", F.lit("")).alias("source_text")))
    v = extraction.validated(extraction.extract(j, client))
    return v.select("record_id", F.size("skills").alias("n_skills"), F.size("relations").alias("n_relations"), "skill_rejection_count", "relation_rejection_count")


def shard_gaps(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "embedding_shards").filter("row_start % 120 <> 40").select("row_start", "row_end")
    return audit.gaps(s, "row_start", "row_end").select("row_start", "row_end")


def line_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return audit.not_contiguous(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


def detail_fanout(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("qid"), F.col("o_custkey").alias("doc"), "o_orderkey")
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc"), "c_name")
    return engine.with_details(r, c).select("qid", "o_orderkey", F.coalesce("c_name", F.lit("")).alias("detail"), "missing")


def repeated_ids(spark: SparkSession, sf: str) -> DataFrame:
    return audit.repeated(table(spark, sf, "vectors").select("job_index"), "job_index")


def row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return audit.numbered(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", F.col("row_number").cast("bigint").alias("row_number"))


def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(X.chunk_text("text")).alias("view_index", "chunk"))


def view_records(spark: SparkSession, sf: str) -> DataFrame:
    """Views of every posting in canonical order: occupation, skill, requirement and content chunks."""
    j = enough_tasks(table(spark, sf, "jobs"))
    kinds = {"occupation": ["title", "duty_minor", "duty_middle", "duty_major", "industry_minor"], "skill": ["computer_skills", "work_skills", "professional_certifications"], "requirement": ["experience_requirement", "education_requirement", "major_requirement_1", "language_1"]}
    views = X.with_job_lines(j, kinds).select("job_id", F.col("source_row").alias("job_row"), "description", *kinds)
    entries = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(k).alias("kind"), F.array(F.col(k)).alias("texts")) for i, k in enumerate(kinds)], F.struct(F.lit(len(kinds)).alias("o"), F.lit("content").alias("kind"), F.col("chunks").alias("texts")))
    e = views.withColumn("chunks", X.chunk_text("description")).select("job_id", "job_row", F.explode(entries).alias("e"))
    return e.select("job_id", "job_row", "e.kind", F.posexplode("e.texts").alias("view_index", "text")).filter("text <> ''")


def taxonomy_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "jobs_raw").select(F.trim("工作城市編號").alias("code"), F.trim("工作城市").alias("term"))
    return taxonomy.from_rows(r, "code", "term")


def taxonomy_children(spark: SparkSession, sf: str) -> DataFrame:
    p = taxonomy.paths(table(spark, sf, "duty_taxonomy"))
    return p.groupBy(F.element_at("path", -1).alias("root")).agg(F.count("*").alias("nodes"), F.max(F.size("path")).cast("int").alias("depth"))


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            query_corrections, correction_apply, stratified_hash_sample, extraction_requests, trec_rows, trec_validate, eval_metrics, ablation_delta, zero_result_queries, staging_audit, null_normalise,
            salary_casts, jobs_latest_delivery, snapshot_differences, row_order_digest, blocked_order_digest, inventory_rules, inventory_unused, release_totals, required_artifacts, forbidden_paths, extracted_evidence, shard_gaps, line_gaps, detail_fanout, repeated_ids, row_numbers,
            chunk_paragraphs, view_records, taxonomy_from_rows, taxonomy_children, window_counts,
        )
    }


def _metrics_sql(order: str) -> str:
    return f"""(WITH r AS (SELECT event_type AS qid, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY {order}, event_id) AS rank FROM events QUALIFY rank <= 1000),
      j AS (SELECT event_type AS qid, event_id AS doc, user_id % 7 AS grade FROM events WHERE user_id % 7 IN (1, 2)),
      i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc) AS n FROM j), b AS (SELECT qid, sum((pow(2, grade) - 1) / log2(n + 1)) FILTER (n <= 10) AS idcg, count(*) AS rel FROM i GROUP BY qid),
      g AS (SELECT qid, sum((pow(2, grade) - 1) / log2(rank + 1)) FILTER (rank <= 10) AS dcg, count(*) FILTER (rank <= 10) AS hits, max((rank = 1)::INT) AS top, min(rank) AS first, count(*) FILTER (rank <= 100) AS r100, count(*) FILTER (rank <= 1000) AS r1000 FROM r JOIN j USING (qid, doc) GROUP BY qid)
      SELECT qid, coalesce(dcg / idcg, 0) AS ndcg_10, coalesce(hits / 10.0::DOUBLE, 0) AS precision_10, coalesce(top::DOUBLE, 0) AS top_1, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(r100::DOUBLE / rel, 0) AS recall_100, coalesce(r1000::DOUBLE / rel, 0) AS recall_1000 FROM b LEFT JOIN g USING (qid))"""


NAMES = ["ndcg_10", "precision_10", "top_1", "mrr", "recall_100", "recall_1000"]


def oracle_sql() -> dict[str, str]:
    fix = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in FIXES.items()) + "}"
    rules = ", ".join(f"('{r}')" for r in RULES)
    long = lambda t: " UNION ALL ".join(f"SELECT '{n}' AS metric, round(avg({n}), 6) AS v FROM {t}" for n in NAMES)
    return {
        "query_corrections": "WITH c AS (SELECT p_name || ' ' || p_size AS surface, lower(p_type) AS target, count(*) AS support FROM part GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY surface) AS targets FROM c WHERE surface <> target) SELECT surface AS source, target, support FROM k WHERE targets = 1 AND support >= 1",
        "correction_apply": f"WITH t AS (SELECT job_id, lower(title) AS t, coalesce(({fix})[lower(title)], array_to_string(list_transform(string_split(lower(title), ' '), lambda w: coalesce(({fix})[w], w)), ' ')) AS c FROM jobs) SELECT job_id, CASE WHEN c = t THEN t ELSE t || '|' || c END AS texts FROM t",
        "stratified_hash_sample": """WITH c AS (SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY ALL), q AS (SELECT s, n, 1 + floor((100 - (SELECT count(*) FROM c)) * sqrt(n) / (SELECT sum(sqrt(n)) FROM c)) AS q FROM c),
          q2 AS (SELECT s, q + CASE WHEN row_number() OVER (ORDER BY n DESC, s) = 1 THEN 100 - (SELECT sum(q) FROM q) ELSE 0 END AS q FROM q),
          r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('split-1' || chr(0) || o_orderkey), o_orderkey::VARCHAR) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM r JOIN q2 ON s = o_orderpriority WHERE k <= q""",
        "extraction_requests": "SELECT job_id, sha256(coalesce(description, '')) AS source_text_sha256, sha256(job_id || chr(0) || sha256(coalesce(description, ''))) AS record_id FROM jobs WHERE source_modified_at < TIMESTAMP '2026-05-01' AND CASE WHEN lower(trim(coalesce(duty_minor, ''))) = 'null' THEN '' ELSE trim(coalesce(duty_minor, '')) END <> ''",
        "trec_rows": "WITH r AS (SELECT event_type AS qid, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 1000) SELECT printf('%s Q0 %s %d %.12f lodeline', qid, doc::VARCHAR, rank, (count(*) OVER (PARTITION BY qid) - rank + 1)::DOUBLE) AS line FROM r",
        "trec_validate": """WITH r AS (SELECT event_type AS qid, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 1000), n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS rows FROM r),
          v AS (SELECT qid, CASE WHEN rank % 90 = 0 THEN rank + 5000 ELSE rank END AS rk, rank % 50 = 0 OR rank % 70 = 0 AS bad FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rk) AS place FROM v)
          SELECT qid, 'malformed' AS rule, count(*) AS n FROM p WHERE bad GROUP BY qid UNION ALL SELECT qid, 'rank not contiguous', count(*) FROM p WHERE rk <> place GROUP BY qid""",
        "eval_metrics": f"SELECT qid, {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)} FROM {_metrics_sql('value DESC')} t",
        "ablation_delta": f"""WITH a AS {_metrics_sql('value DESC')}, b AS {_metrics_sql('ts DESC')}, x AS ({long('a')}), y AS ({long('b')})
          SELECT metric, x.v AS off, y.v AS "on", round(y.v - x.v, 6) AS delta, metric <> 'ndcg_10' OR round(y.v - x.v, 6) > 0 AS passed FROM x JOIN y USING (metric)""",
        "zero_result_queries": "SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
        "staging_audit": 'SELECT count(*) AS n_rows, count(DISTINCT "職缺編號") AS n_keys, min(source_row) AS least, max(source_row) AS greatest, count(*) FILTER ("職缺編號" IS NULL OR trim("職缺編號") = \'\' OR "職務名稱" IS NULL OR trim("職務名稱") = \'\') AS n_incomplete FROM jobs_raw',
        "null_normalise": "SELECT " + ", ".join(f"count(nullif(nullif(\"{c}\", ''), 'NULL')) AS n_{i}" for i, c in enumerate(DELIVERY_COLUMNS)) + " FROM jobs_raw",
        "salary_casts": "SELECT p_partkey, p_retailprice::DECIMAL(12,2)::DOUBLE AS price, try_cast(p_name AS DECIMAL(12,2)) IS NULL AS not_a_number FROM part",
        "jobs_latest_delivery": "SELECT job_id, source_row::BIGINT AS source_row FROM jobs",
        "snapshot_differences": "SELECT 'only_first' AS side, count(*) AS n FROM orders WHERE o_orderkey % 97 = 0",
        "row_order_digest": "SELECT count(*) AS n_rows, sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS digest FROM nation",
        "blocked_order_digest": "WITH b AS (SELECT o_orderkey // 1000 AS b, count(*) AS n, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) ORDER BY o_orderkey) || chr(10)) AS d FROM orders GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM b",
        "inventory_rules": f"SELECT vectors_path AS path, count(p) AS n_rules FROM embedding_shards LEFT JOIN (VALUES {rules}) AS r(p) ON starts_with(vectors_path, p) GROUP BY ALL HAVING count(p) <> 1",
        "inventory_unused": f"SELECT p AS prefix FROM (VALUES {rules}) AS r(p) WHERE NOT EXISTS (SELECT 1 FROM embedding_shards WHERE starts_with(vectors_path, p))",
        "release_totals": "SELECT count(*) AS objects, sum(row_end - row_start)::BIGINT AS bytes, sha256(string_agg(vectors_path || ' ' || sha256(vectors_path) || ' ' || (row_end - row_start), chr(10) ORDER BY vectors_path)) AS inventory_hash FROM embedding_shards",
        "required_artifacts": f"SELECT vectors_path AS path, row_end - row_start AS size_bytes FROM embedding_shards WHERE starts_with(vectors_path, '{RULES[0]}') OR starts_with(vectors_path, '{RULES[2]}')",
        "forbidden_paths": "SELECT p_brand || '/' || p_name AS path, count(*) AS n FROM part WHERE list_has_any(string_split(regexp_replace(lower(p_brand || '/' || p_name), '[^a-z0-9]+', '_', 'g'), '_'), ['red', '7']) GROUP BY ALL",
        "shard_gaps": "WITH s AS (SELECT row_start, row_end FROM embedding_shards WHERE row_start % 120 <> 40) SELECT row_start, row_end FROM s WHERE row_start NOT IN (SELECT row_end FROM s) AND row_start <> (SELECT min(row_start) FROM s)",
        "line_gaps": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING min(l_linenumber) <> 1 OR count(DISTINCT l_linenumber) <> count(*) OR max(l_linenumber) - min(l_linenumber) + 1 <> count(*)",
        "detail_fanout": "SELECT o_orderpriority AS qid, o_orderkey, coalesce(c_name, '') AS detail, count(*) FILTER (c_custkey IS NULL) OVER (PARTITION BY o_orderpriority) AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
        "repeated_ids": "SELECT job_index, count(*) AS n FROM vectors GROUP BY ALL HAVING count(*) > 1",
        "row_numbers": "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS row_number FROM customer",
        "taxonomy_from_rows": 'SELECT DISTINCT trim("工作城市編號") AS code, trim("工作城市") AS term FROM jobs_raw WHERE trim("工作城市編號") <> \'\' AND trim("工作城市") <> \'\'',
        "taxonomy_children": "SELECT trim(codenamec) AS root, count(*) AS nodes, max(len(list_distinct([trim(codenamea), trim(codenameb), trim(codenamec)])))::INT AS depth FROM duty_taxonomy GROUP BY 1",
        "window_counts": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    }
