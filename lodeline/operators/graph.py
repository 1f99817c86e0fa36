"""Skill graph: derivation from evidence, one-hop expansion of queries, fusion with a protected head, traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.runtime import bounded, settled

# Relation types and the limits of the expansion.
RELATION_TYPES = ["RELATED_TO", "SPECIALIZATION_OF", "USED_WITH"]
SEED_JOBS = 10
MIN_SEED_JOBS = 2
MAX_ANCHORS = 8
MAX_DUTY_ANCHORS = 4
MIN_DUTY_SUPPORT = 2
EDGES_PER_ANCHOR = 10
MAX_BRIDGES = 16
JOBS_PER_BRIDGE = 50
RRF_K = 60
PROTECTED_HEAD = 3
NOVEL_IN_TOP = 2
PATHS_PER_CANDIDATE = 5
SPANS_PER_PATH = 3


def _first(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "_n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n).drop(name)


# ---- derivation


def skill_support(mentions: DataFrame, minimum: int = 1) -> DataFrame:
    """``skill, support``: records that hold the skill. mentions: ``record, duty, skill, category``."""
    return mentions.select("record", "skill").distinct().groupBy("skill").agg(F.count("*").alias("support")).filter(F.col("support") >= minimum)


def category_majority(mentions: DataFrame) -> DataFrame:
    """``skill, category``: the most frequent category, ties in alphabetical order."""
    counts = mentions.groupBy("skill", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("skill").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"))


def category_conflicts(mentions: DataFrame) -> DataFrame:
    """``skill, categories, mentions`` of skills named in more than one category."""
    return mentions.groupBy("skill").agg(F.countDistinct("category").alias("categories"), F.count("*").alias("mentions")).filter("categories > 1")


def duty_skills(mentions: DataFrame, minimum: int = 1, support: DataFrame | None = None) -> DataFrame:
    """``duty, skill, support, weight``: weight is the share of the duty's records that hold the skill. support: a stored ``skill_support``."""
    promoted = skill_support(mentions, minimum) if support is None else support
    sizes = mentions.select("record", "duty").distinct().groupBy("duty").agg(F.count("*").alias("size"))
    pairs = mentions.select("record", "duty", "skill").distinct().join(promoted.select("skill"), "skill", "left_semi")
    return pairs.groupBy("duty", "skill").agg(F.count("*").alias("support")).join(sizes, "duty").select("duty", "skill", "support", (F.col("support") / F.col("size")).alias("weight"))


def skill_relations(relations: DataFrame, mentions: DataFrame, minimum: int = 1, support: DataFrame | None = None) -> DataFrame:
    """``source, type, target, support, weight``: weight = support / sqrt(support of source * support of target); both ends promoted."""
    sup = skill_support(mentions, minimum) if support is None else support
    clean = relations.filter(F.col("type").isin(RELATION_TYPES) & (F.col("source") != F.col("target")))
    n = clean.select("record", "source", "type", "target").distinct().groupBy("source", "type", "target").agg(F.count("*").alias("support")).filter(F.col("support") >= minimum)
    s = sup.select(F.col("skill").alias("source"), F.col("support").alias("s"))
    t = sup.select(F.col("skill").alias("target"), F.col("support").alias("t"))
    return n.join(s, "source").join(t, "target").select("source", "type", "target", "support", (F.col("support") / F.sqrt(F.col("s") * F.col("t"))).alias("weight"))


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """``record, rule`` of evidence rows ``record, source_text, surface, span`` whose span isn't in the text or whose surface isn't in the span."""
    checks = F.array(
        F.when(~F.contains(F.col("source_text"), F.col("span")), F.lit("span outside text")),
        F.when(~F.contains(F.col("span"), F.col("surface")), F.lit("surface outside span")),
        F.when(F.trim("surface") == "", F.lit("empty surface")),
    )
    return evidence.select("record", F.explode(F.array_compact(checks)).alias("rule"))


def undirected(relations: DataFrame) -> DataFrame:
    """Each relation under both of its ends: ``skill, related, source, type, target, weight``."""
    both = F.array(F.struct(F.col("source").alias("skill"), F.col("target").alias("related")), F.struct(F.col("target").alias("skill"), F.col("source").alias("related")))
    return relations.select(F.explode(both).alias("e"), "source", "type", "target", "weight").select("e.skill", "e.related", "source", "type", "target", "weight")


# ---- expansion


def alias_anchors(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``qid, skill, priority, strength`` of the skills a query names.

    queries: ``qid, text, tokens``; aliases: ``alias, skill``. An ASCII alias needs all of its words among the query's tokens and, if
    it has several, to stand in the text; other aliases need to stand in the text. Words meet by equi-join; only aliases of other scripts are tested against each query.
    """
    a = aliases.select("alias", "skill").distinct().filter(F.length("alias") >= 2)
    ascii_ = a.filter(F.col("alias").rlike(r"^[\x00-\x7F]*$")).withColumn("words", F.array_distinct(F.regexp_extract_all("alias", F.lit(r"([a-z0-9][a-z0-9+#.\-]*)"), 1))).filter(F.size("words") > 0)
    q = queries.select("qid", F.explode("tokens").alias("word"), "text", "tokens")
    met = q.join(ascii_.withColumn("word", F.element_at("words", 1)), "word")
    ok = (F.size(F.array_except("words", "tokens")) == 0) & ((F.size("words") == 1) | F.contains(F.col("text"), F.col("alias")))
    named = met.filter(ok).select("qid", "skill")
    other = a.filter(~F.col("alias").rlike(r"^[\x00-\x7F]*$"))
    named = named.unionByName(other.join(bounded(queries.select("qid", "text"), 100_000, "queries"), F.contains(F.col("text"), F.col("alias"))).select("qid", "skill"))
    return named.distinct().select("qid", "skill", F.lit(0).alias("priority"), F.lit(1.0).alias("strength"))


def duty_anchors(query_duties: DataFrame, duty_edges: DataFrame) -> DataFrame:
    """The best skills over all duties ``qid, duty`` of a query."""
    met = query_duties.join(duty_edges.filter(F.col("support") >= MIN_DUTY_SUPPORT), "duty")
    top = _first(met, ["qid"], [F.col("weight").desc(), F.col("support").desc(), F.col("skill")], MAX_DUTY_ANCHORS)
    return top.select("qid", "skill", F.lit(1).alias("priority"), F.col("weight").alias("strength"))


def seed_anchors(baseline: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Skills that at least two of the first ten baseline jobs known to the graph share. baseline: ``qid, doc, rank``."""
    near = job_skills.select("doc", "skill").join(baseline.select("doc").distinct(), "doc", "left_semi").distinct()  # edges of baseline jobs only
    seeds = _first(baseline.join(near.select("doc").distinct(), "doc", "left_semi"), ["qid"], [F.col("rank")], SEED_JOBS)
    total = seeds.groupBy("qid").agg(F.count("*").alias("seeds"))
    counts = seeds.join(near, "doc").groupBy("qid", "skill").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SEED_JOBS)
    return counts.join(total, "qid").select("qid", "skill", F.lit(2).alias("priority"), (F.col("n") / F.col("seeds")).alias("strength"))


def select_anchors(*sources: DataFrame) -> DataFrame:
    """``qid, skill, priority, strength``: each skill once at its best, the first eight of a query."""
    all_ = sources[0]
    for s in sources[1:]:
        all_ = all_.unionByName(s)
    best = all_.groupBy("qid", "skill").agg(F.min(F.struct("priority", (-F.col("strength")).alias("s"))).alias("b")).select("qid", "skill", F.col("b.priority").alias("priority"), (-F.col("b.s")).alias("strength"))
    return _first(best, ["qid"], [F.col("priority"), F.round("strength", 9).desc(), F.col("skill")], MAX_ANCHORS)


def anchor_edges(anchors: DataFrame, relations: DataFrame) -> DataFrame:
    """``qid, skill, strength, related, source, type, target, weight``: the strongest relations of every anchor."""
    edges = _first(undirected(relations), ["skill"], [F.round("weight", 9).desc(), F.col("source"), F.col("type"), F.col("target")], EDGES_PER_ANCHOR)
    return anchors.join(edges, "skill")


def bridges(anchors: DataFrame, relations: DataFrame) -> DataFrame:
    """``qid, bridge, strength``: related skills by the summed strength of the anchors that lead to them."""
    s = anchor_edges(anchors, relations).groupBy("qid", F.col("related").alias("bridge")).agg(F.sum(F.col("strength") * F.col("weight")).alias("strength"))
    return _first(s, ["qid"], [F.round("strength", 9).desc(), F.col("bridge")], MAX_BRIDGES)


def graph_ranks(bridge_hits: DataFrame) -> DataFrame:
    """``qid, doc, graph_score, graph_rank`` from ``qid, bridge, strength, doc, rank``."""
    s = bridge_hits.groupBy("qid", "doc").agg(F.sum(F.col("strength") / (RRF_K + F.col("rank"))).alias("graph_score"))
    w = Window.partitionBy("qid").orderBy(F.round("graph_score", 9).desc(), F.col("doc").cast("decimal(38,0)"))
    return s.withColumn("graph_rank", F.row_number().over(w))


def fuse(baseline: DataFrame, graph: DataFrame) -> DataFrame:
    """``qid, doc, base_rank, graph_rank, rrf, fused``: reciprocal ranks over the union of both."""
    f = baseline.select("qid", "doc", F.col("rank").alias("base_rank")).join(graph.select("qid", "doc", "graph_rank"), ["qid", "doc"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0))
    f = f.withColumn("rrf", part("base_rank") + part("graph_rank"))
    w = Window.partitionBy("qid").orderBy(F.round("rrf", 9).desc(), F.coalesce("base_rank", F.lit(10**9)), F.col("doc").cast("decimal(38,0)"))
    return f.withColumn("fused", F.row_number().over(w))


def protect(fused: DataFrame) -> DataFrame:
    """Adds ``rank``: the baseline's head first, then the fused order with at most a few novel rows among the first ten. In closed form by running sums."""
    q = Window.partitionBy("qid")
    novel = F.col("base_rank").isNull()
    d = fused.withColumn("head", F.coalesce(F.col("base_rank") <= PROTECTED_HEAD, F.lit(False)))
    d = d.withColumn("n_base", F.count("base_rank").over(q)).withColumn("n_head", F.count_if("head").over(q))
    run = q.orderBy("fused").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("novel_n", F.sum(F.when(~F.col("head") & novel, 1).otherwise(0)).over(run))
    limit = F.greatest(F.lit(NOVEL_IN_TOP), 10 - F.least(F.lit(10), F.col("n_base")))
    d = d.withColumn("fits", ~F.col("head") & (~novel | (F.col("novel_n") <= limit)))
    d = d.withColumn("fit_n", F.sum(F.col("fits").cast("int")).over(run))
    d = d.withColumn("band", F.when(F.col("head"), 0).when(F.col("fits") & (F.col("fit_n") <= 10 - F.col("n_head")), 1).otherwise(2))
    w = q.orderBy("band", F.when(F.col("head"), F.col("base_rank")).otherwise(F.col("fused")))
    return d.withColumn("rank", F.row_number().over(w)).drop("head", "n_base", "n_head", "novel_n", "fits", "fit_n", "band")


def restate(ranked: DataFrame, limit: int) -> DataFrame:
    """The first rows with scores n - rank + 1."""
    cut = ranked.filter(F.col("rank") <= limit)
    return cut.withColumn("score", (F.count("*").over(Window.partitionBy("qid")) - F.col("rank") + 1).cast("double"))


def conditioned_search(baseline: DataFrame, anchors: DataFrame, relations: DataFrame, search: Callable[[DataFrame], DataFrame], limit: int = 1_000) -> DataFrame:
    """Graph-conditioned retrieval of a batch. ``search`` takes ``qid, bridge`` and gives ``qid, bridge, doc, rank`` under the query's own filters."""
    b = settled(bridges(anchors, relations))  # at most MAX_BRIDGES a query
    hits = search(b.select("qid", "bridge")).filter(F.col("rank") <= JOBS_PER_BRIDGE).join(b, ["qid", "bridge"])
    return restate(protect(fuse(baseline, graph_ranks(hits))), limit)


def path_traces(edges: DataFrame, bridge_hits: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``qid, doc, paths, total, retained, omitted``: the best paths anchor - relation - bridge of every candidate, with a few evidence spans each.

    edges: ``anchor_edges``; bridge_hits: ``qid, bridge, doc, rank``; spans: ``source, type, target, span``.
    """
    p = edges.select("qid", F.col("skill").alias("anchor"), "related", "strength", "source", "type", "target", "weight").join(bridge_hits.select("qid", F.col("bridge").alias("related"), "doc", "rank"), ["qid", "related"])
    p = p.withColumn("path_score", F.col("strength") * F.col("weight") / (RRF_K + F.col("rank")))
    w = Window.partitionBy("qid", "doc").orderBy(F.round("path_score", 9).desc(), "rank", "anchor", "related", "source", "type", "target")
    p = p.withColumn("n", F.row_number().over(w))
    totals = p.groupBy("qid", "doc").agg(F.count("*").alias("total"), F.sum("path_score").alias("total_score"), F.sum(F.when(F.col("n") <= PATHS_PER_CANDIDATE, F.col("path_score"))).alias("retained_score"))
    kept = p.filter(F.col("n") <= PATHS_PER_CANDIDATE)
    if spans is not None:
        s = _first(spans.select("source", "type", "target", "span").distinct(), ["source", "type", "target"], [F.col("span")], SPANS_PER_PATH).groupBy("source", "type", "target").agg(F.array_sort(F.collect_list("span")).alias("spans"))
        kept = kept.join(s, ["source", "type", "target"], "left")
    cols = ["n", "anchor", "related", "source", "type", "target", "path_score", *(["spans"] if spans is not None else [])]
    paths = kept.groupBy("qid", "doc").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("paths"))
    return totals.join(paths, ["qid", "doc"]).withColumn("retained", F.size("paths")).withColumn("omitted", F.col("total") - F.size("paths"))


def trace_skill(skill: DataFrame, mentions: DataFrame, duty_edges: DataFrame, relations: DataFrame, limit: int = 10, evidence: DataFrame | None = None) -> DataFrame:
    """``skill, kind, item, weight`` for given skills: jobs, duties, relations, the relations' evidence and the jobs of related skills, a limited number of each.

    evidence: ``record, source, type, target``. Evidence is limited for each relation, related jobs for each related skill.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must lie between 1 and 100")
    asked = skill.select("skill").distinct()
    held = mentions.select("skill", F.col("record").cast("string").alias("record")).distinct()
    jobs = held.select("skill", F.lit("job").alias("kind"), F.col("record").alias("item"), F.lit(1.0).alias("weight"))
    duties = duty_edges.select("skill", F.lit("duty").alias("kind"), F.col("duty").alias("item"), "weight")
    edge = F.concat_ws(">", "source", "type", "target")
    own = undirected(relations).join(asked, "skill", "left_semi").distinct()
    related = _first(own, ["skill"], [F.round("weight", 9).desc(), F.col("source"), F.col("type"), F.col("target")], limit)
    parts = [
        _first(jobs.unionByName(duties).join(asked, "skill", "left_semi"), ["skill", "kind"], [F.round("weight", 9).desc(), F.col("item")], limit),
        related.select("skill", F.lit("relation").alias("kind"), edge.alias("item"), "weight"),
    ]
    near = related.select("skill", "related").distinct().join(held.withColumnRenamed("skill", "related"), "related")
    parts.append(_first(near, ["skill", "related"], [F.col("record")], limit).select("skill", F.lit("related job").alias("kind"), F.concat_ws("/", "related", "record").alias("item"), F.lit(1.0).alias("weight")))
    if evidence is not None:
        borne = related.select("skill", "source", "type", "target").join(evidence.select(F.col("record").cast("string").alias("record"), "source", "type", "target").distinct(), ["source", "type", "target"])
        parts.append(_first(borne, ["skill", "source", "type", "target"], [F.col("record")], limit).select("skill", F.lit("evidence").alias("kind"), F.concat_ws("/", edge, "record").alias("item"), F.lit(1.0).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trace_lines(traces: DataFrame) -> DataFrame:
    """``line``: one JSON object for each candidate of ``path_traces``."""
    return traces.select(F.to_json(F.struct("doc", "omitted", "paths", "qid", "retained", "retained_score", "total", "total_score")).alias("line"))


def graph_violations(job_skills: DataFrame, skills: DataFrame, relations: DataFrame, relation_evidence: DataFrame) -> DataFrame:
    """``rule, key`` of broken references: unknown skills, unknown ends, evidence whose ends the record doesn't hold."""
    known = skills.select("skill")
    a = job_skills.select("skill").distinct().join(known, "skill", "left_anti").select(F.lit("unknown skill").alias("rule"), F.col("skill").alias("key"))
    ends = relations.select(F.explode(F.array("source", "target")).alias("skill")).distinct()
    b = ends.join(known, "skill", "left_anti").select(F.lit("unknown end").alias("rule"), F.col("skill").alias("key"))
    e = relation_evidence.select("record", F.explode(F.array("source", "target")).alias("skill")).distinct()
    c = e.join(job_skills.select("record", "skill").distinct(), ["record", "skill"], "left_anti").select(F.lit("end not on record").alias("rule"), F.concat_ws("/", F.col("record").cast("string"), "skill").alias("key"))
    return a.unionByName(b).unionByName(c)
