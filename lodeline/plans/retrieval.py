"""Queries of the retrieval and graph operators on the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.functions import times, vectors
from lodeline.operators import dense, engine, evaluate, graph, lexical, taxonomy
from lodeline.runtime import enough_tasks, literal, materialize, settled, stored, table

QUERIES = [("q1", "weekly stock reports"), ("q2", "shift rosters using python"), ("q3", "customer refund cases"), ("q4", "manual steps excel sql")]
JOB_TERMS = [("j1", "python engineer"), ("j2", "excel word outlook"), ("j3", "sql docker kubernetes")]
GRAPH_QUERIES = [("g1", "brand#3 brand#7 parts", "BUILDING"), ("g2", "brand#11", "HOUSEHOLD"), ("g3", "economy brand#20 brand#1", "MACHINERY")]
MIN_SUPPORT = 2
WORDS_SQL = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9][a-z0-9+#.\-]*')"


def _values(rows: list[tuple], cols: str) -> str:
    cell = lambda v: str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({cols})"


# ---- tokens and index


def lexical_tokens_ascii(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.explode(F.array_distinct(X.latin_words(F.col("text")))).alias("token"))


def han_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "jobs").select("job_id", "duty_minor")
    return d.select("job_id", F.explode(X.native_tokens(F.col("duty_minor"))).alias("token"))


def lexical_tokens_full(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "jobs").select("job_id", "title", "description")
    return d.select("job_id", X.lexical_tokens("title").alias("title_tokens"), F.size(X.lexical_tokens("description")).alias("n_body_tokens"))


def html_canonical_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.canonical_text("text").alias("canonical"))


def field_serialise_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    parts = [("name", F.col("p_name")), ("type", F.col("p_type")), ("brand", F.col("p_brand")), ("colour", F.split("p_name", " ")[0]), ("kind", F.lower("p_type"))]
    return p.select("p_partkey", X.serialise(parts).alias("document"))


def job_documents(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "jobs").select("job_id", *[n for _, n in X.JOB_FIELDS])
    return X.with_job_lines(j, {"document": [n for _, n in X.JOB_FIELDS]}).select("job_id", "document")


def _doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = enough_tasks(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return lexical.token_fields(d, {"body": X.latin_words(F.col("text"))})


def postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    i = lexical.build(_doc_tokens(spark, sf))
    return i.terms.join(F.broadcast(i.fields), "field").select("field", "term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def _terms(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    q = literal(spark, rows, "qid string, text string")
    return q.select("qid", F.explode(X.query_terms(X.native_tokens(F.col("text")))).alias("term"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    q = _terms(spark, QUERIES[:1])
    s = lexical.score(q, lexical.build(_doc_tokens(spark, sf), q))
    return lexical.top_k(s, 10).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    q = _terms(spark, QUERIES)
    s = lexical.score(q, lexical.build(_doc_tokens(spark, sf), q))
    return lexical.top_k(s, 100).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_filtered_before_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    docs = d.select(F.col("doc_id").alias("doc"), "text", F.coalesce("source", F.lit("")).alias("location"), F.coalesce("lang", F.lit("")).alias("duty"), F.when(F.col("text").isNull(), "0").otherwise("1").alias("visible"), F.unix_millis(F.col("posted_at").cast("timestamp")).alias("updated_ms"))
    index = lambda terms: lexical.build(lexical.token_fields(enough_tasks(docs), {"body": X.latin_words(F.col("text"))}, kept=FILTERS), terms, FILTERS)
    r = literal(spark, [("q1", ["portal_feed", "web_form"], ["en"]), ("q2", [], ["en", "zh"]), ("q3", ["crawler"], []), ("q4", None, ["en"])], "qid string, locations array<string>, duties array<string>").withColumn("minimum_ms", F.lit(1_767_225_600_000))
    q = _terms(spark, QUERIES)
    s = lexical.score(q, index(q), requests=r)
    return lexical.top_k(s, 20).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_fielded_boosts(spark: SparkSession, sf: str) -> DataFrame:
    j = enough_tasks(table(spark, sf, "jobs").select(F.col("job_id").alias("doc"), "title", "computer_skills", "description"))
    q = _terms(spark, JOB_TERMS)
    i = lexical.build(lexical.token_fields(j, {"title": X.latin_words(F.col("title")), "skills": X.latin_words(F.col("computer_skills")), "body": X.latin_words(F.col("description"))}), q)
    return lexical.top_k(lexical.score(q, i, X.FIELD_BOOSTS), 50).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_jobs_full(spark: SparkSession, sf: str) -> DataFrame:
    """All five field groups of the postings with labels, full tokens, weights; visible and recent rows only."""
    j = table(spark, sf, "jobs")
    d = j.select(F.col("job_id").alias("doc"), F.col("source_modified_at").alias("t"), *[n for _, n in X.JOB_FIELDS])
    words = materialize(X.with_job_words(enough_tasks(d), X.FIELD_GROUPS).select("doc", *X.FIELD_GROUPS))  # tokenised once
    q = literal(spark, [("c1", "資料工程師 Python"), ("c2", "門市人員 排班"), ("c3", "會計 Excel")], "qid string, text string")
    terms = q.select("qid", F.explode(X.query_terms(X.lexical_tokens("text"))).alias("term"))
    i = lexical.build(lexical.token_fields(words, {g: F.col(g) for g in X.FIELD_GROUPS}), terms)
    visible = table(spark, sf, "jobs_raw").filter(F.col("是否公開") == "1").select(F.col("職缺編號").alias("doc")).distinct()
    newest = d.agg(F.max(F.when(F.col("t") < F.lit("2027-01-01").cast("timestamp_ntz"), F.col("t"))).alias("m"))
    recent = d.crossJoin(F.broadcast(newest)).filter(F.col("t") >= F.col("m") - F.expr("interval 180 days")).select("doc")  # one row
    eligible = recent.join(visible, "doc", "left_semi")
    return lexical.top_k(lexical.score(terms, i, X.FIELD_BOOSTS, eligible), 200).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def bm25_sql(occurrences: str, documents: str, queries: str, k: int, boosts: dict[str, float] | None = None, eligible: str | None = None) -> str:
    """SQL of build, score and top_k: occurrences(field, doc, term), documents(doc), queries(qid, term), eligible(qid, doc)."""
    boost = "CASE p.field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items()) + " END" if boosts else "1.0"
    return f"""occ AS ({occurrences}), docs AS ({documents}), q AS (SELECT DISTINCT qid, term FROM ({queries})),
tf AS (SELECT field, doc, term, count(*) AS tf FROM occ GROUP BY ALL),
dl AS (SELECT field, doc, sum(tf) AS dl FROM tf GROUP BY ALL),
fs AS (SELECT field, sum(dl)::DOUBLE / (SELECT count(*) FROM docs) AS avgdl, (SELECT count(*) FROM docs) AS n FROM dl GROUP BY field),
dfs AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL){", elig AS (" + eligible + ")" if eligible else ""},
scored AS (SELECT q.qid, p.doc, sum({boost} * ln(1 + (fs.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / fs.avgdl))) AS score
  FROM q JOIN tf p USING (term) JOIN dl ON dl.field = p.field AND dl.doc = p.doc JOIN dfs ON dfs.field = p.field AND dfs.term = p.term JOIN fs ON fs.field = p.field
  {"WHERE (q.qid, p.doc) IN (SELECT (qid, doc) FROM elig)" if eligible else ""} GROUP BY ALL),
ranked AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc::VARCHAR) AS rank FROM scored QUALIFY rank <= {k})"""


def _terms_sql(rows: list[tuple[str, str]]) -> str:
    return f"SELECT qid, unnest({WORDS_SQL.format('txt')}) AS term FROM {_values(rows, 'qid, txt')}"


DOC_OCC = f"SELECT 'body' AS field, doc_id AS doc, unnest({WORDS_SQL.format('text')}) AS term FROM documents"
RANKED = "SELECT qid, doc, round(score, 6) AS score, rank::INT AS rank FROM ranked"

# ---- eligibility and time


def eligible_universe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("doc"), F.col("event_type").alias("location"), (F.col("user_id") % 5).cast("string").alias("duty"), F.when(F.col("value") > 1, "1").otherwise("0").alias("visible"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_ms"))
    r = literal(spark, [("e1", ["click", "view"], [], 1705312800000), ("e2", [], ["1", "3"], 1704067200000), ("e3", ["purchase"], ["2"], 1706000000000)], "qid string, locations array<string>, duties array<string>, minimum_ms long")
    return lexical.eligible_rows(e, r)


def temporal_future_retained(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts")
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    kept = e.filter(F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    return kept.select("event_id", F.round(times.freshness(F.col("ts"), as_of), 6).alias("freshness"), (F.col("ts") > as_of).alias("future"))


def naive_ts_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "jobs").select("job_id", F.col("source_modified_at").alias("t"))
    utc = times.naive_to_utc(F.col("t"))
    return j.select("job_id", utc.cast("timestamp_ntz").alias("utc"), F.unix_millis(utc).alias("epoch_ms"), times.end_of_day(F.col("t").cast("date")).cast("timestamp_ntz").alias("as_of"))


def delivery_times(spark: SparkSession, sf: str) -> DataFrame:
    """The several notations of delivery times, zoned or not, as UTC."""
    t = F.regexp_replace(F.trim("職缺最後修改時間"), "/", "-")
    return table(spark, sf, "jobs_raw").select("source_row", times.parse_source(t).cast("timestamp_ntz").alias("utc"))


# ---- taxonomy


def taxonomy_expand(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.expand(table(spark, sf, "location_taxonomy"))


def taxonomy_expand_twice(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.expand(table(spark, sf, "location_taxonomy"), passes=2)


def taxonomy_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.reverse(taxonomy.expand(table(spark, sf, "duty_taxonomy"))).select("term", F.array_join("codes", ",").alias("codes"))


RESOLVE = [("r1", ["100100"]), ("r2", ["100101", "100102"]), ("r3", ["100101", "999999"]), ("r4", [])]


def taxonomy_resolve(spark: SparkSession, sf: str) -> DataFrame:
    r = literal(spark, RESOLVE, "qid string, codes array<string>")
    return taxonomy.resolve(r, taxonomy.expand(table(spark, sf, "location_taxonomy"))).select("qid", F.array_join("terms", ",").alias("terms"))


TAX = "p AS (SELECT codeno AS code, list_filter([trim(codenamea), trim(codenameb), trim(codenamec)], lambda x: x <> '') AS path FROM {}), x AS (SELECT DISTINCT a.code, unnest(b.path) AS term FROM p a JOIN p b ON list_has_all(b.path, a.path))"
TAX2 = ", s AS (SELECT code, list(DISTINCT term) AS terms FROM x GROUP BY code), y AS (SELECT DISTINCT a.code, unnest(b.terms) AS term FROM s a JOIN s b ON list_has_all(b.terms, a.terms))"

# ---- order analogue: orders are postings, brands are skills, segments are duties, nations are places


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("o_orderkey").alias("doc"), F.col("c_mktsegment").alias("duty"), F.col("n_name").alias("location"), F.when(F.col("o_orderstatus") == "P", "0").otherwise("1").alias("visible"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_ms"), F.col("o_orderdate").alias("updated"))


ORDERS = "SELECT o_orderkey AS doc, c_mktsegment AS duty, n_name AS location, CASE WHEN o_orderstatus = 'P' THEN '0' ELSE '1' END AS visible, epoch_ms(o_orderdate) AS updated_ms, o_orderdate AS updated FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")  # noqa: E741
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_brand").alias("brand"), "p_type")
    return l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("record"), "l_linenumber", "brand", "p_type")


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = _orders(spark, sf).select(F.col("doc").alias("record"), "duty")
    return _lines(spark, sf).join(d, "record").select("record", "duty", F.col("brand").alias("skill"), F.col("p_type").alias("category"))


MENTIONS = "SELECT l_orderkey AS record, c_mktsegment AS duty, lower(p_brand) AS skill, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
TYPES = ["RELATED_TO", "SPECIALIZATION_OF", "USED_WITH"]


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    l = _lines(spark, sf)  # noqa: E741
    a = l.select("record", F.col("l_linenumber").alias("n"), F.col("brand").alias("source"))
    b = l.select("record", (F.col("l_linenumber") - 1).alias("n"), F.col("brand").alias("target"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("n") % 3 + 1).cast("int"))
    return a.join(b, ["record", "n"]).filter("source <> target").select("record", "source", kind.alias("type"), "target")


RELATIONS = f"SELECT a.l_orderkey AS record, lower(pa.p_brand) AS source, {TYPES!r}[a.l_linenumber % 3 + 1] AS type, lower(pb.p_brand) AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN part pa ON a.l_partkey = pa.p_partkey JOIN part pb ON b.l_partkey = pb.p_partkey WHERE lower(pa.p_brand) <> lower(pb.p_brand)"
GRAPH = f"""mentions AS ({MENTIONS}), rel AS ({RELATIONS}),
sup AS (SELECT skill, count(DISTINCT record) AS support FROM mentions GROUP BY skill HAVING count(DISTINCT record) >= {MIN_SUPPORT}),
sizes AS (SELECT duty, count(DISTINCT record) AS size FROM mentions GROUP BY duty),
ds AS (SELECT duty, skill, count(DISTINCT record) AS support, count(DISTINCT record)::DOUBLE / any_value(size) AS weight FROM mentions JOIN sup USING (skill) JOIN sizes USING (duty) GROUP BY duty, skill),
rn AS (SELECT source, type, target, count(DISTINCT record) AS support FROM rel GROUP BY ALL HAVING count(DISTINCT record) >= {MIN_SUPPORT}),
sr AS (SELECT source, type, target, rn.support, rn.support / sqrt(s.support::DOUBLE * t.support) AS weight FROM rn JOIN sup s ON source = s.skill JOIN sup t ON target = t.skill)"""


def skill_support(spark: SparkSession, sf: str) -> DataFrame:
    return graph.skill_support(_mentions(spark, sf), MIN_SUPPORT)


def category_majority(spark: SparkSession, sf: str) -> DataFrame:
    return graph.category_majority(_mentions(spark, sf))


def category_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.category_conflicts(_mentions(spark, sf))


def duty_skill_weights(spark: SparkSession, sf: str) -> DataFrame:
    return graph.duty_skills(_mentions(spark, sf), MIN_SUPPORT).withColumn("weight", F.round("weight", 6))


def skill_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.skill_relations(_relations(spark, sf), _mentions(spark, sf), MIN_SUPPORT).withColumn("weight", F.round("weight", 6))


def undirected_relation_join(spark: SparkSession, sf: str) -> DataFrame:
    u = graph.undirected(graph.skill_relations(_relations(spark, sf), _mentions(spark, sf), MIN_SUPPORT))
    return u.select("skill", "related", "type", F.round("weight", 6).alias("weight"))


def skill_trace(spark: SparkSession, sf: str) -> DataFrame:
    m = _mentions(spark, sf)
    s = literal(spark, [("brand#3",), ("brand#7",)], "skill string")
    rel = _relations(spark, sf)
    t = graph.trace_skill(s, m, graph.duty_skills(m, MIN_SUPPORT), graph.skill_relations(rel, m, MIN_SUPPORT), evidence=rel)
    return t.withColumn("weight", F.round("weight", 6)).distinct()


def graph_integrity(spark: SparkSession, sf: str) -> DataFrame:
    m = _mentions(spark, sf)
    few = graph.skill_support(m, 2_250).select("skill")
    r = graph.skill_relations(_relations(spark, sf), m, MIN_SUPPORT)
    v = graph.graph_violations(m.select("record", "skill"), few, r, _relations(spark, sf))
    return v.groupBy("rule").agg(F.count("*").alias("n"))


FILTERS = ["location", "duty", "visible", "updated_ms"]


def _graph_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The orders with what filters look at and their brands in the order of lines; stored, since index, mentions and relations are narrow views of it."""
    lines = _lines(spark, sf).groupBy(F.col("record").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), "brand"))).alias("lines"))  # a few lines an order
    return stored(_orders(spark, sf).select("doc", *FILTERS).join(lines, "doc", "left"))


def _brand_index(documents: DataFrame) -> lexical.Index:
    """The index of the orders by their brands; postings carry what hard filters look at."""
    brands = F.array_distinct(F.transform("lines", lambda x: x["brand"]))
    return lexical.build(lexical.token_fields(documents, {"body": brands}, kept=FILTERS), kept=FILTERS)


def _line_relations(documents: DataFrame) -> DataFrame:
    """``_relations`` as a narrow view of the stored orders."""
    after = lambda a: F.transform(F.filter("lines", lambda b: (b["n"] == a["n"] + 1) & (b["brand"] != a["brand"])), lambda b: F.struct(a.alias("a"), b.alias("b")))
    p = documents.select(F.col("doc").alias("record"), F.explode(F.flatten(F.transform("lines", after))).alias("p"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("p.a.n") % 3 + 1).cast("int"))
    return p.select("record", F.col("p.a.brand").alias("source"), kind.alias("type"), F.col("p.b.brand").alias("target"))


def _graph_queries(spark: SparkSession) -> DataFrame:
    q = literal(spark, GRAPH_QUERIES, "qid string, text string, duty string")
    return q.withColumn("tokens", X.latin_words(F.col("text")))


def _graph_requests(spark: SparkSession) -> DataFrame:
    rows = [(q, [], [d], 852076800000) for q, _, d in GRAPH_QUERIES]
    return literal(spark, rows, "qid string, locations array<string>, duties array<string>, minimum_ms long")


def _baseline(spark: SparkSession, index: lexical.Index, k: int = 1_000) -> DataFrame:
    q = _graph_queries(spark).select("qid", F.explode("tokens").alias("term"))
    return lexical.top_k(lexical.score(q, index, requests=_graph_requests(spark)), k)


def _held(index: lexical.Index) -> DataFrame:
    """Job-skill edges with the job's duty, as the postings of the brand index hold them."""
    return index.postings.select(F.col("doc").alias("record"), "duty", F.col("term").alias("skill"))


def _graph_tables(documents: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promoted skills, duty edges and relations, stored as a build would store them; their size is that of the skill vocabulary."""
    support = settled(graph.skill_support(held, MIN_SUPPORT))
    return support, settled(graph.duty_skills(held, MIN_SUPPORT, support)), settled(graph.skill_relations(_line_relations(documents), held, MIN_SUPPORT, support))


def _anchors(spark: SparkSession, baseline: DataFrame, held: DataFrame, support: DataFrame, duties: DataFrame) -> DataFrame:
    q = _graph_queries(spark)
    aliases = support.select(F.col("skill").alias("alias"), "skill")
    seeds = graph.seed_anchors(baseline, held.select(F.col("record").alias("doc"), "skill").join(support.select("skill"), "skill", "left_semi"))
    return graph.select_anchors(graph.alias_anchors(q, aliases), graph.duty_anchors(q.select("qid", "duty"), duties), seeds)


def bridge_terms(spark: SparkSession, sf: str) -> DataFrame:
    _, anchors, relations, _ = _search(spark, sf)
    return graph.bridges(anchors, relations).select("qid", "bridge", F.round("strength", 6).alias("strength"))


def _search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    documents = _graph_documents(spark, sf)
    index = _brand_index(documents)
    index = lexical.Index(index.postings, settled(index.fields), settled(index.terms))
    base = settled(_baseline(spark, index))
    held = _held(index)
    support, duties, relations = _graph_tables(documents, held)

    def search(b: DataFrame) -> DataFrame:
        """All bridges of all queries in one batch, each under its query's filters."""
        terms = b.select("qid", "bridge", F.explode(X.query_terms(X.native_tokens(F.col("bridge")))).alias("term"))
        keys = ("qid", "bridge")
        return lexical.top_k(lexical.score(terms, index, requests=_graph_requests(spark), keys=keys), graph.JOBS_PER_BRIDGE, keys=keys).select(*keys, "doc", "rank")

    return base, settled(_anchors(spark, base, held, support, duties)), relations, search


def graph_conditioned_search(spark: SparkSession, sf: str) -> DataFrame:
    base, anchors, relations, search = _search(spark, sf)
    return graph.conditioned_search(base, anchors, relations, search, 200).select("qid", "doc", "rank", F.coalesce("base_rank", F.lit(0)).alias("base_rank"), F.coalesce("graph_rank", F.lit(0)).alias("graph_rank"), "score")


def graph_run_statistics(spark: SparkSession, sf: str) -> DataFrame:
    base, anchors, relations, search = _search(spark, sf)
    return evaluate.run_statistics(graph.conditioned_search(base, anchors, relations, search, 1_000), base)


def path_trace_topk(spark: SparkSession, sf: str) -> DataFrame:
    base, anchors, relations, search = _search(spark, sf)
    hits = search(graph.bridges(anchors, relations).select("qid", "bridge"))
    edges = graph.anchor_edges(anchors, relations)
    kept = graph.bridges(anchors, relations).select("qid", F.col("bridge").alias("related"))
    t = graph.path_traces(edges.join(kept, ["qid", "related"], "left_semi"), hits)
    return t.select("qid", "doc", "total", F.round("total_score", 6).alias("total_score"), F.round("retained_score", 6).alias("retained_score"), "retained", "omitted")


BASE = bm25_sql(
    "SELECT DISTINCT 'body' AS field, l_orderkey AS doc, lower(p_brand) AS term FROM lineitem JOIN part ON l_partkey = p_partkey",
    f"SELECT doc FROM ({ORDERS})",
    f"SELECT qid, unnest({WORDS_SQL.format('txt')}) AS term FROM {_values(GRAPH_QUERIES, 'qid, txt, duty')}",
    1_000,
    eligible=f"SELECT g.qid, o.doc FROM {_values(GRAPH_QUERIES, 'qid, txt, duty').replace('AS t(', 'AS g(')} JOIN ({ORDERS}) o ON o.duty = g.duty WHERE o.visible = '1' AND o.updated_ms >= 852076800000",
)
ANCHORS = f"""gq AS (SELECT qid, txt, duty, {WORDS_SQL.format('txt')} AS tokens FROM {_values(GRAPH_QUERIES, 'qid, txt, duty')}),
al AS (SELECT qid, skill, 0 AS priority, 1.0::DOUBLE AS strength FROM gq JOIN sup ON list_contains(tokens, skill)),
da AS (SELECT qid, skill, 1 AS priority, weight AS strength FROM gq JOIN ds USING (duty) WHERE support >= 2 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY weight DESC, support DESC, skill) <= 4),
js AS (SELECT DISTINCT record AS doc, skill FROM mentions JOIN sup USING (skill)),
seeds AS (SELECT qid, doc FROM ranked WHERE doc IN (SELECT doc FROM js) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 10),
sa AS (SELECT qid, skill, 2 AS priority, count(*)::DOUBLE / any_value(n) AS strength FROM seeds JOIN js USING (doc) JOIN (SELECT qid, count(*) AS n FROM seeds GROUP BY qid) USING (qid) GROUP BY qid, skill HAVING count(*) >= 2),
best AS (SELECT * FROM (SELECT * FROM al UNION ALL SELECT * FROM da UNION ALL SELECT * FROM sa) QUALIFY row_number() OVER (PARTITION BY qid, skill ORDER BY priority, strength DESC) = 1),
anchors AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY qid ORDER BY priority, round(strength, 9) DESC, skill) <= 8),
und AS (SELECT source AS skill, target AS related, * FROM sr UNION ALL SELECT target AS skill, source AS related, * FROM sr),
edges AS (SELECT * FROM und QUALIFY row_number() OVER (PARTITION BY skill ORDER BY round(weight, 9) DESC, source, type, target) <= 10),
ae AS (SELECT qid, skill, strength, related, source, type, target, weight FROM anchors JOIN edges USING (skill)),
b0 AS (SELECT qid, related AS bridge, sum(strength * weight) AS strength FROM ae GROUP BY qid, related),
br AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(strength, 9) DESC, bridge) <= 16)"""
HITS = """bt AS (SELECT DISTINCT qid, bridge, unnest(list_concat([bridge], list_filter(regexp_split_to_array(bridge, '[-+#.]+'), lambda p: p <> ''))) AS term FROM br),
bs AS (SELECT bt.qid, bt.bridge, p.doc, sum(ln(1 + (fs.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dl.dl / fs.avgdl))) AS score
  FROM bt JOIN tf p USING (term) JOIN dl ON dl.field = p.field AND dl.doc = p.doc JOIN dfs ON dfs.field = p.field AND dfs.term = p.term JOIN fs ON fs.field = p.field WHERE (bt.qid, p.doc) IN (SELECT (qid, doc) FROM elig) GROUP BY ALL),
hits AS (SELECT qid, bridge, doc, row_number() OVER (PARTITION BY qid, bridge ORDER BY round(score, 9) DESC, doc::VARCHAR) AS rank FROM bs QUALIFY rank <= 50)"""
FUSED = """gs AS (SELECT qid, doc, sum(strength / (60 + rank)) AS g FROM hits JOIN br USING (qid, bridge) GROUP BY ALL),
gr AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(g, 9) DESC, doc) AS graph_rank FROM gs),
fu AS (SELECT coalesce(b.qid, g.qid) AS qid, coalesce(b.doc, g.doc) AS doc, b.rank AS base_rank, graph_rank, coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + graph_rank), 0) AS rrf FROM ranked b FULL OUTER JOIN gr g ON b.qid = g.qid AND b.doc = g.doc),
fo AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, coalesce(base_rank, 1000000000), doc) AS fused FROM fu)"""
PROTECT = """h AS (SELECT *, coalesce(base_rank <= 3, false) AS head, count(base_rank) OVER (PARTITION BY qid) AS n_base FROM fo),
h2 AS (SELECT *, sum(head::INT) OVER (PARTITION BY qid) AS n_head, sum((NOT head AND base_rank IS NULL)::INT) OVER (PARTITION BY qid ORDER BY fused ROWS UNBOUNDED PRECEDING) AS novel_n FROM h),
h3 AS (SELECT *, NOT head AND (base_rank IS NOT NULL OR novel_n <= greatest(2, 10 - least(10, n_base))) AS fits FROM h2),
h4 AS (SELECT *, sum(fits::INT) OVER (PARTITION BY qid ORDER BY fused ROWS UNBOUNDED PRECEDING) AS fit_n FROM h3),
h5 AS (SELECT *, CASE WHEN head THEN 0 WHEN fits AND fit_n <= 10 - n_head THEN 1 ELSE 2 END AS band FROM h4),
fin AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY band, CASE WHEN head THEN base_rank ELSE fused END) AS rank, base_rank, graph_rank FROM h5)"""


TOP_SCORE = 1_001


def rrf_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    base, graph_side = _two_lanes(spark, sf)
    return graph.fuse(base, graph_side.withColumnRenamed("rank", "graph_rank")).select("qid", "doc", F.coalesce("base_rank", F.lit(0)).alias("base_rank"), F.coalesce("graph_rank", F.lit(0)).alias("graph_rank"), F.round("rrf", 6).alias("rrf"), "fused")


def protected_order(spark: SparkSession, sf: str) -> DataFrame:
    base, graph_side = _two_lanes(spark, sf)
    return graph.protect(graph.fuse(base, graph_side.withColumnRenamed("rank", "graph_rank"))).select("qid", "doc", "rank")


def _two_lanes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Per event type the events by value, and by time for values below 50: two rankings that overlap in part."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("qid"), F.col("event_id").alias("doc"), "value", "ts")
    a = e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("value").desc(), "doc"))).filter("rank <= 1000")
    b = e.filter("value < 50").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ts").desc(), "doc"))).filter("rank <= 200")
    return a.select("qid", "doc", "rank", "value"), b.select("qid", "doc", "rank", "value")


LANES = """ranked AS (SELECT event_type AS qid, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, value FROM events QUALIFY rank <= 1000),
gr AS (SELECT event_type AS qid, event_id AS doc, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS graph_rank, value FROM events WHERE value < 50 QUALIFY graph_rank <= 200),"""


def lane_merge_shadow_tail(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_lanes(spark, sf)
    lanes = a.filter((F.col("value") > 300) & (F.col("rank") <= engine.MAX_LANE_ROWS)).select("qid", F.lit("bm25").alias("lane"), F.lit(True).alias("required"), "doc", "value", "rank").unionByName(b.select("qid", F.lit("dense").alias("lane"), F.lit(False).alias("required"), "doc", "value", "rank"))
    c = lanes.withColumn("score", (TOP_SCORE - F.col("rank")).cast("double"))
    meta = table(spark, sf, "events").select(F.col("event_id").alias("doc"), F.col("ts").alias("updated"))
    m = engine.merge(c, meta, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 10)
    return m.select("qid", "doc", "position", "best_rank", F.round("contribution", 6).alias("contribution"), F.round("freshness", 6).alias("freshness"), "future", F.size("evidence").alias("n_evidence"))


def audit_trace_json(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_lanes(spark, sf)
    lanes = a.filter(F.col("rank") <= engine.MAX_LANE_ROWS).select("qid", F.lit("bm25").alias("lane"), F.lit(True).alias("required"), "doc", "rank").unionByName(b.select("qid", F.lit("dense").alias("lane"), F.lit(False).alias("required"), "doc", "rank")).withColumn("score", (TOP_SCORE - F.col("rank")).cast("double"))
    meta = table(spark, sf, "events").select(F.col("event_id").alias("doc"), F.col("ts").alias("updated"))
    return engine.audit_trace(engine.merge(lanes, meta, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")))


def ordered_lane_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two_lanes(spark, sf)
    return engine.ordered_union(a.select("qid", F.lit(0).alias("lane_order"), "doc", "rank").unionByName(b.select("qid", F.lit(1).alias("lane_order"), "doc", "rank")))


def lane_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("qid"), F.lit("bm25").alias("lane"), F.col("event_id").cast("string").alias("doc"), F.col("value").alias("score"), "ts")
    ranked = e.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ts", "doc"))).drop("ts")
    return engine.lane_violations(ranked).groupBy("qid", "rule").agg(F.count("*").alias("n"))


def hard_filter_revalidate(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf)
    meta = o.select("doc", F.array("location").alias("location_codes"), F.array("duty").alias("duty_codes"), "updated_ms")
    r = literal(spark, [("h1", ["NATION_1", "NATION_2", "NATION_3"], [], 852076800000), ("h2", [], ["BUILDING"], 820454400000)], "qid string, locations array<string>, duties array<string>, minimum_ms long")
    c = o.select(F.when(F.col("doc") % 2 == 0, "h1").otherwise("h2").alias("qid"), F.lit("dense").alias("lane"), F.lit(False).alias("required"), "doc", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return engine.revalidate(c, meta, r).groupBy("qid", F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


def metadata_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ids = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(ids, "o_custkey", "left_semi")


def missing_ids_anti(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


DETAILS = ["title", "work_city", "salary_text", "duty_major", "duty_middle", "duty_minor", "description", "experience_requirement", "education_requirement", "work_skills"]


def details(jobs: DataFrame) -> DataFrame:
    """``job_id, details``: the eleven labelled values of a posting, null where it states none."""
    label = {name: text for text, name in X.JOB_FIELDS}
    pairs = [x for c in DETAILS for x in (F.lit(label[c]), F.col(c))]
    modified = F.date_format(F.col("source_modified_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return jobs.select("job_id", F.create_map(*pairs, F.lit("職缺最後修改時間"), modified).alias("details"))


def detail_projection(spark: SparkSession, sf: str) -> DataFrame:
    return details(table(spark, sf, "jobs")).select("job_id", F.explode("details").alias("label", "value"))


# ---- dense


def _vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label")


def _vec_queries(v: DataFrame) -> DataFrame:
    return v.filter(F.col("doc") % 100 == 0).select(F.col("doc").cast("string").alias("qid"), F.col("vec").alias("qvec"))


def dense_topk_exact(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    return dense.exact_top_k(_vec_queries(v), v, 10).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def dense_topk_eligible(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    return dense.exact_top_k(_vec_queries(v), v, 5, v.filter("label in (1, 3, 5)").select("doc")).select("qid", "doc", F.round("score", 6).alias("score"), "rank")


def dense_topk_batched(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    return dense.batched_top_k(_vec_queries(v), v, 10).select("qid", "doc", "rank")


def dense_prefix_renorm(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    return v.select("doc", F.posexplode(vectors.prefix_unit(F.col("vec"), 16)).alias("pos", "v")).select("doc", "pos", F.round("v", 6).alias("v"))


def serving_vectors_half(spark: SparkSession, sf: str) -> DataFrame:
    return dense.serving_vectors(_vec(spark, sf).select("doc", "vec"), 16)


def vector_norm_audit(spark: SparkSession, sf: str) -> DataFrame:
    return dense.norm_audit(_vec(spark, sf))


def posting_vector_audit(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vectors").select(F.col("job_index").alias("doc"), F.col("embedding").alias("vec"))
    return dense.norm_audit(v)


def maxsim_multiview(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    return dense.max_sim(_vec_queries(v), v.select(F.col("label").alias("doc"), "vec")).select("qid", "doc", F.round("score", 6).alias("score"))


EVEC = "qv AS (SELECT vec_id::VARCHAR AS qid, embedding::DOUBLE[] AS qvec FROM embeddings WHERE vec_id % 100 = 0), sc AS (SELECT qid, vec_id AS doc, label, list_dot_product(embedding::DOUBLE[], qvec) AS score FROM embeddings, qv)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            lexical_tokens_ascii, han_ngrams, lexical_tokens_full, html_canonical_text, field_serialise_dedup, job_documents, postings_stats, bm25_topk, bm25_topk_batch, bm25_filtered_before_topk,
            bm25_fielded_boosts, bm25_jobs_full, eligible_universe, temporal_future_retained, naive_ts_to_utc, delivery_times, taxonomy_expand, taxonomy_expand_twice, taxonomy_reverse, taxonomy_resolve,
            skill_support, category_majority, category_conflicts, duty_skill_weights, skill_relations, undirected_relation_join, skill_trace, graph_integrity, bridge_terms, graph_conditioned_search,
            graph_run_statistics, path_trace_topk, rrf_full_outer, protected_order, lane_merge_shadow_tail, audit_trace_json, ordered_lane_union, lane_contract_violations, hard_filter_revalidate,
            metadata_semijoin, missing_ids_anti, detail_projection, dense_topk_exact, dense_topk_eligible, dense_topk_batched, dense_prefix_renorm, serving_vectors_half, vector_norm_audit, posting_vector_audit, maxsim_multiview,
        )
    }


def oracle_sql() -> dict[str, str]:
    fresh = "CASE WHEN {t} > {a} THEN 0.0 ELSE greatest(0.0, 1 - (epoch_us({a}) - epoch_us({t})) / 86400000000.0 / 180) END"
    as_of = "TIMESTAMP '2024-01-20 00:00:00'"
    elig_docs = f"""SELECT qid, doc_id AS doc FROM documents, (VALUES ('q1', ['portal_feed', 'web_form'], ['en']), ('q2', []::VARCHAR[], ['en', 'zh']), ('q3', ['crawler'], []::VARCHAR[])) AS r(qid, l, d)
      WHERE text IS NOT NULL AND epoch_ms(posted_at) >= 1767225600000 AND (len(l) = 0 OR list_contains(l, coalesce(source, ''))) AND (len(d) = 0 OR list_contains(d, coalesce(lang, '')))"""
    job_occ = " UNION ALL ".join(f"SELECT '{f}' AS field, job_id AS doc, unnest({WORDS_SQL.format(c)}) AS term FROM jobs" for f, c in (("title", "title"), ("skills", "computer_skills"), ("body", "description")))
    usable = "SELECT {id}, {v}::DOUBLE[] AS v, ({v} IS NOT NULL AND len({v}) > 0 AND len(list_filter({v}, lambda x: NOT isfinite(x) OR x IS NULL)) = 0) AS fin FROM {t}"
    audit = "SELECT count(*) AS n_rows, count(*) FILTER (NOT u) AS n_unusable, count(*) FILTER (u AND abs(norm - 1) > 2e-3) AS n_off_norm, round(max(abs(norm - 1)) FILTER (u), 6) AS max_deviation FROM (SELECT fin AND norm > 0 AS u, norm FROM (SELECT fin, CASE WHEN fin THEN sqrt(list_sum(list_transform(v, lambda x: x * x))) ELSE 0 END AS norm FROM w))"
    return {
        "lexical_tokens_ascii": f"SELECT DISTINCT doc_id, unnest({WORDS_SQL.format('text')}) AS token FROM documents",
        # &nbsp; is the only whole entity in these tables; the blanks and the word limit are those of Unicode
        "html_canonical_text": r"""WITH e AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), '&nbsp;', chr(160)), '&#8$', '') AS raw FROM documents),
          t AS (SELECT doc_id, raw, regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g') AS t FROM e),
          l AS (SELECT doc_id, raw, regexp_replace(t, '(?i)(^|[^\p{L}\p{N}_])(?:https?://|www\.)[^\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1 ', 'g') AS t FROM t)
          SELECT doc_id, CASE WHEN lower(trim(raw)) = 'null' THEN '' ELSE trim(regexp_replace(t, '[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) END AS canonical FROM l""",
        "han_ngrams": r"""WITH r AS (SELECT job_id, unnest(regexp_extract_all(lower(coalesce(duty_minor, '')), '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+')) AS run FROM jobs),
          w AS (SELECT job_id, unnest(regexp_extract_all(lower(coalesce(duty_minor, '')), '[a-z0-9][a-z0-9+#.\-]*')) AS word FROM jobs)
          SELECT DISTINCT job_id, token FROM (SELECT job_id, unnest(list_transform(range(1, length(run) + 1), lambda i: substring(run, i, 1))) AS token FROM r
          UNION ALL SELECT job_id, unnest(list_transform(range(1, length(run)), lambda i: substring(run, i, 2))) FROM r UNION ALL SELECT job_id, run FROM r WHERE length(run) <= 8
          UNION ALL SELECT job_id, word FROM w UNION ALL SELECT job_id, unnest(list_filter(regexp_split_to_array(word, '[-+#.]+'), lambda p: p <> '')) FROM w)""",
        "field_serialise_dedup": """WITH e AS (SELECT p_partkey, unnest([{'i': 1, 'l': 'name', 'v': p_name}, {'i': 2, 'l': 'type', 'v': p_type}, {'i': 3, 'l': 'brand', 'v': p_brand}, {'i': 4, 'l': 'colour', 'v': split_part(p_name, ' ', 1)}, {'i': 5, 'l': 'kind', 'v': lower(p_type)}]) AS x FROM part),
          k AS (SELECT p_partkey, x.i AS i, x.l || ': ' || x.v AS line FROM e WHERE trim(x.v) <> '' QUALIFY row_number() OVER (PARTITION BY p_partkey, lower(trim(x.v)) ORDER BY x.i) = 1)
          SELECT p_partkey, string_agg(line, chr(10) ORDER BY i) AS document FROM k GROUP BY p_partkey""",
        "postings_stats": f"WITH {bm25_sql(DOC_OCC, 'SELECT doc_id AS doc FROM documents', _terms_sql(QUERIES), 10)} SELECT field, term, df, n, round(avgdl, 6) AS avgdl FROM dfs JOIN fs USING (field)",
        "bm25_topk": f"WITH {bm25_sql(DOC_OCC, 'SELECT doc_id AS doc FROM documents', _terms_sql(QUERIES[:1]), 10)} {RANKED}",
        "bm25_topk_batch": f"WITH {bm25_sql(DOC_OCC, 'SELECT doc_id AS doc FROM documents', _terms_sql(QUERIES), 100)} {RANKED}",
        "bm25_filtered_before_topk": f"WITH {bm25_sql(DOC_OCC, 'SELECT doc_id AS doc FROM documents', _terms_sql(QUERIES), 20, eligible=elig_docs)} {RANKED}",
        "bm25_fielded_boosts": f"WITH {bm25_sql(job_occ, 'SELECT job_id AS doc FROM jobs', _terms_sql(JOB_TERMS), 50, {k: v for k, v in X.FIELD_BOOSTS.items() if k in ('title', 'skills', 'body')})} {RANKED}",
        "eligible_universe": "SELECT qid, event_id AS doc FROM events, (VALUES ('e1', ['click', 'view'], []::VARCHAR[], 1705312800000), ('e2', []::VARCHAR[], ['1', '3'], 1704067200000), ('e3', ['purchase'], ['2'], 1706000000000)) AS r(qid, l, d, m) WHERE value > 1 AND epoch_ms(ts) >= m AND (len(l) = 0 OR list_contains(l, event_type)) AND (len(d) = 0 OR list_contains(d, (user_id % 5)::VARCHAR))",
        "temporal_future_retained": f"SELECT event_id, round({fresh.format(t='ts', a=as_of)}, 6) AS freshness, ts > {as_of} AS future FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'",
        "naive_ts_to_utc": "SELECT job_id, source_modified_at - INTERVAL 8 HOUR AS utc, epoch_ms(source_modified_at - INTERVAL 8 HOUR) AS epoch_ms, source_modified_at::DATE + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND - INTERVAL 8 HOUR AS as_of FROM jobs",
        "taxonomy_expand": f"WITH {TAX.format('location_taxonomy')} SELECT code, term FROM x",
        "taxonomy_expand_twice": f"WITH {TAX.format('location_taxonomy')}{TAX2} SELECT code, term FROM y",
        "taxonomy_reverse": f"WITH {TAX.format('duty_taxonomy')} SELECT term, string_agg(code, ',' ORDER BY code) AS codes FROM x GROUP BY term",
        "taxonomy_resolve": f"""WITH {TAX.format('location_taxonomy')}, r AS (SELECT * FROM (VALUES ('r1', ['100100']), ('r2', ['100101', '100102']), ('r3', ['100101', '999999']), ('r4', []::VARCHAR[])) AS t(qid, codes)),
          u AS (SELECT qid, unnest(codes) AS code FROM r), a AS (SELECT qid, count(*) FILTER (x.term IS NULL) AS bad, string_agg(DISTINCT x.term, ',' ORDER BY x.term) AS terms FROM u LEFT JOIN x ON u.code = x.code GROUP BY qid)
          SELECT r.qid, CASE WHEN len(codes) = 0 THEN '' WHEN bad > 0 THEN NULL ELSE terms END AS terms FROM r LEFT JOIN a USING (qid)""",
        "skill_support": f"WITH {GRAPH} SELECT skill, support FROM sup",
        "category_majority": f"SELECT skill, category FROM (SELECT skill, category, count(*) AS n FROM ({MENTIONS}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY skill ORDER BY n DESC, category) = 1",
        "category_conflicts": f"SELECT skill, count(DISTINCT category) AS categories, count(*) AS mentions FROM ({MENTIONS}) GROUP BY skill HAVING count(DISTINCT category) > 1",
        "duty_skill_weights": f"WITH {GRAPH} SELECT duty, skill, support, round(weight, 6) AS weight FROM ds",
        "skill_relations": f"WITH {GRAPH} SELECT source, type, target, support, round(weight, 6) AS weight FROM sr",
        "undirected_relation_join": f"WITH {GRAPH} SELECT source AS skill, target AS related, type, round(weight, 6) AS weight FROM sr UNION ALL SELECT target, source, type, round(weight, 6) FROM sr",
        "skill_trace": f"""WITH {GRAPH}, h AS (SELECT DISTINCT skill, record::VARCHAR AS record FROM mentions), a AS (SELECT skill, 'job' AS kind, record AS item, 1.0::DOUBLE AS weight FROM h UNION ALL SELECT skill, 'duty', duty, weight FROM ds),
          u AS (SELECT source AS skill, target AS related, * FROM sr UNION ALL SELECT target, source, * FROM sr), r AS (SELECT DISTINCT * FROM u WHERE skill IN ('brand#3', 'brand#7') QUALIFY row_number() OVER (PARTITION BY skill ORDER BY round(weight, 9) DESC, source, type, target) <= 10),
          rj AS (SELECT r.skill, related, record FROM (SELECT DISTINCT skill, related FROM r) r JOIN h ON h.skill = related QUALIFY row_number() OVER (PARTITION BY r.skill, related ORDER BY record) <= 10),
          ev AS (SELECT skill, source, type, target, record FROM r JOIN (SELECT DISTINCT record::VARCHAR AS record, source, type, target FROM rel) USING (source, type, target) QUALIFY row_number() OVER (PARTITION BY skill, source, type, target ORDER BY record) <= 10)
          SELECT skill, kind, item, round(weight, 6) AS weight FROM (SELECT * FROM a WHERE skill IN ('brand#3', 'brand#7') QUALIFY row_number() OVER (PARTITION BY skill, kind ORDER BY round(weight, 9) DESC, item) <= 10)
          UNION ALL SELECT skill, 'relation', source || '>' || type || '>' || target, round(weight, 6) FROM r UNION ALL SELECT skill, 'related job', related || '/' || record, 1.0 FROM rj UNION ALL SELECT skill, 'evidence', source || '>' || type || '>' || target || '/' || record, 1.0 FROM ev""",
        "graph_integrity": f"""WITH {GRAPH}, few AS (SELECT skill FROM mentions GROUP BY skill HAVING count(DISTINCT record) >= 2250), v AS (
          SELECT 'unknown skill' AS rule, skill AS k FROM (SELECT DISTINCT skill FROM mentions) WHERE skill NOT IN (SELECT skill FROM few)
          UNION ALL SELECT 'unknown end', s FROM (SELECT DISTINCT unnest([source, target]) AS s FROM sr) WHERE s NOT IN (SELECT skill FROM few)
          UNION ALL SELECT 'end not on record', s FROM (SELECT DISTINCT record, unnest([source, target]) AS s FROM rel) e WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.record = e.record AND m.skill = e.s)) SELECT rule, count(*) AS n FROM v GROUP BY rule""",
        "bridge_terms": f"WITH {GRAPH}, {BASE}, {ANCHORS} SELECT qid, bridge, round(strength, 6) AS strength FROM br",
        "graph_conditioned_search": f"WITH {GRAPH}, {BASE}, {ANCHORS}, {HITS}, {FUSED}, {PROTECT} SELECT qid, doc, rank::INT AS rank, coalesce(base_rank, 0)::INT AS base_rank, coalesce(graph_rank, 0)::INT AS graph_rank, (least(200, count(*) OVER (PARTITION BY qid)) - rank + 1)::DOUBLE AS score FROM fin QUALIFY rank <= 200",
        "graph_run_statistics": f"WITH {GRAPH}, {BASE}, {ANCHORS}, {HITS}, {FUSED}, {PROTECT}, c AS (SELECT * FROM fin WHERE rank <= 1000) SELECT count(DISTINCT qid) AS queries, count(*) AS rows, count(*) FILTER (base_rank IS NULL) AS novel_rows, count(DISTINCT qid) FILTER (base_rank IS NULL) AS queries_with_novel, count(*) FILTER (base_rank IS NULL AND rank <= 10) AS novel_in_top_10, count(*) FILTER (rank = 1 AND coalesce(base_rank, 0) <> 1) AS changed_first FROM c",
        "path_trace_topk": f"""WITH {GRAPH}, {BASE}, {ANCHORS}, {HITS}, p AS (SELECT ae.qid, h.doc, strength * weight / (60 + rank) AS s, rank, ae.skill, ae.related, source, type, target FROM ae JOIN hits h ON h.qid = ae.qid AND h.bridge = ae.related),
          n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY round(s, 9) DESC, rank, skill, related, source, type, target) AS n FROM p)
          SELECT qid, doc, count(*) AS total, round(sum(s), 6) AS total_score, round(sum(s) FILTER (n <= 5), 6) AS retained_score, least(5, count(*))::INT AS retained, count(*) - least(5, count(*)) AS omitted FROM n GROUP BY ALL""",
        "rrf_full_outer": f"WITH {LANES} {FUSED.split('fu AS', 1)[1].join(['fu AS', ''])} SELECT qid, doc, coalesce(base_rank, 0)::INT AS base_rank, coalesce(graph_rank, 0)::INT AS graph_rank, round(rrf, 6) AS rrf, fused::INT AS fused FROM fo",
        "protected_order": f"WITH {LANES} {FUSED.split('fu AS', 1)[1].join(['fu AS', ''])}, {PROTECT} SELECT qid, doc, rank::INT AS rank FROM fin",
        "lane_merge_shadow_tail": f"""WITH {LANES} c AS (SELECT qid, doc, rank, true AS required, {TOP_SCORE}.0 - rank AS score FROM ranked WHERE value > 300 AND rank <= 200 UNION ALL SELECT qid, doc, graph_rank, false, {TOP_SCORE}.0 - graph_rank FROM gr),
          m AS (SELECT qid, doc, max(required::INT) AS incumbent, min(rank) AS best_rank, sum(CASE WHEN required THEN score ELSE 0 END) AS contribution, count(*) AS n_evidence FROM c GROUP BY ALL),
          f AS (SELECT m.*, {fresh.format(t='ts', a=as_of)} AS freshness, ts > {as_of} AS future FROM m JOIN events ON doc = event_id)
          SELECT qid, doc, (row_number() OVER (PARTITION BY qid ORDER BY incumbent DESC, best_rank, round(freshness, 9) DESC, doc::VARCHAR))::INT AS position, best_rank::INT AS best_rank, round(contribution, 6)::DOUBLE AS contribution, round(freshness, 6) AS freshness, future, n_evidence::INT AS n_evidence FROM f QUALIFY position <= 10""",
        "ordered_lane_union": f"WITH {LANES} u AS (SELECT qid, doc, 0 AS o, rank AS r FROM ranked UNION ALL SELECT qid, doc, 1, graph_rank FROM gr), f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY o, r) = 1) SELECT qid, doc, (row_number() OVER (PARTITION BY qid ORDER BY o, r))::INT AS place FROM f",
        "lane_contract_violations": """WITH r AS (SELECT event_type AS qid, event_id::VARCHAR AS doc, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR) AS rank FROM events),
          d AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, lag(score) OVER (PARTITION BY qid ORDER BY rank) AS b FROM r)
          SELECT qid, rule, count(*) AS n FROM (SELECT qid, 'too many rows' AS rule FROM d WHERE n > 200 UNION ALL SELECT qid, 'score rises' FROM d WHERE score > b) GROUP BY ALL""",
        "hard_filter_revalidate": f"""WITH o AS ({ORDERS}), c AS (SELECT CASE WHEN doc % 2 = 0 THEN 'h1' ELSE 'h2' END AS qid, * FROM o)
          SELECT qid, CASE WHEN updated_ms < CASE qid WHEN 'h1' THEN 852076800000 ELSE 820454400000 END THEN 'stale' WHEN qid = 'h1' AND location NOT IN ('NATION_1', 'NATION_2', 'NATION_3') THEN 'location' WHEN qid = 'h2' AND duty <> 'BUILDING' THEN 'duty' ELSE 'none' END AS violation, count(*) AS n FROM c GROUP BY ALL""",
        "delivery_times": r"""WITH t AS (SELECT source_row, replace(trim("職缺最後修改時間"), '/', '-') AS s FROM jobs_raw)
          SELECT source_row, CASE WHEN regexp_matches(s, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN try_cast(regexp_replace(regexp_replace(s, '(Z|[+-][0-9]{2}:?[0-9]{2})$', ''), 'T', ' ') AS TIMESTAMP) - CASE WHEN s LIKE '%Z' THEN INTERVAL 0 HOUR ELSE to_hours(regexp_extract(s, '([+-][0-9]{2}):?[0-9]{2}$', 1)::INT) END
          ELSE try_cast(replace(s, 'T', ' ') AS TIMESTAMP) - INTERVAL 8 HOUR END AS utc FROM t""",
        "detail_projection": "WITH d AS (SELECT job_id, unnest(["
        + ", ".join(f"{{'label': '{text}', 'value': {name}}}" for text, name in X.JOB_FIELDS if name in DETAILS)
        + ", {'label': '職缺最後修改時間', 'value': strftime(source_modified_at, '%Y-%m-%dT%H:%M:%S.%g')}]) AS x FROM jobs) SELECT job_id, x.label AS label, x.value AS value FROM d",
        "metadata_semijoin": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
        "missing_ids_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
        "dense_topk_exact": f"WITH {EVEC} SELECT qid, doc, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc::VARCHAR))::INT AS rank FROM sc QUALIFY rank <= 10",
        "dense_topk_eligible": f"WITH {EVEC} SELECT qid, doc, round(score, 6) AS score, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc::VARCHAR))::INT AS rank FROM sc WHERE label IN (1, 3, 5) QUALIFY rank <= 5",
        "dense_topk_batched": f"WITH {EVEC} SELECT qid, doc, (row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc::VARCHAR))::INT AS rank FROM sc QUALIFY rank <= 10",
        "dense_prefix_renorm": "WITH p AS (SELECT vec_id AS doc, list_slice(embedding::DOUBLE[], 1, 16) AS v FROM embeddings), n AS (SELECT doc, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM p) SELECT doc, (i - 1)::INT AS pos, round(v[i] / n, 6) AS v FROM n, range(1, 17) AS r(i)",
        "vector_norm_audit": f"WITH w AS ({usable.format(id='vec_id', v='embedding', t='embeddings')}) {audit}",
        "posting_vector_audit": f"WITH w AS ({usable.format(id='job_index', v='embedding', t='vectors')}) {audit}",
        "maxsim_multiview": f"WITH {EVEC} SELECT qid, label AS doc, round(max(score), 6) AS score FROM sc GROUP BY ALL",
    }
