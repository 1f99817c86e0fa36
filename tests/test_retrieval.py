import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.operators import audit, dense, engine, evaluate, extraction, graph, lexical, sampling, taxonomy


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


DOCS = [("1", "100100", "140200", "1", 10), ("2", "100100", "140200", "1", 181), ("3", "100100", "140200", "1", -1), ("4", "100100", "140200", "0", 5), ("5", "100200", "140200", "1", 5)]


def _docs(spark):
    return spark.createDataFrame([(d, l, u, v, -a * 86_400_000) for d, l, u, v, a in DOCS], "doc string, location string, duty string, visible string, updated_ms long")


@pytest.mark.parametrize(("locations", "duties", "expected"), [(["100100"], ["140200"], ["1", "3"]), (["100200"], [], ["5"]), (["100100"], ["140300"], []), (None, [], [])])
def test_filters_come_before_the_cut(spark, locations, duties, expected):
    docs = _docs(spark)
    tokens = lexical.token_fields(docs, {"body": F.array(F.lit("kubernetes"))})
    r = spark.createDataFrame([("q", locations, duties, -180 * 86_400_000)], "qid string, locations array<string>, duties array<string>, minimum_ms long")
    q = spark.createDataFrame([("q", "kubernetes")], "qid string, term string")
    got = lexical.top_k(lexical.score(q, lexical.build(tokens), eligible=lexical.eligible_rows(docs, r)), 2).orderBy("rank").collect()
    assert [x["doc"] for x in got] == expected


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"]), (3, None)], "doc int, t array<string>")
    tokens = lexical.token_fields(docs, {"body": F.col("t")})
    q = spark.createDataFrame([("q", "a")], "qid string, term string")
    s = lexical.score(q, lexical.build(tokens)).collect()
    assert lexical.score(q, lexical.build(tokens, q)).collect() == s
    idf, avg = math.log(1 + 2.5 / 1.5), 4 / 3
    assert len(s) == 1 and s[0]["score"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)))


def test_taxonomy_one_and_two_passes(spark):
    t = spark.createDataFrame([("1", "R", "R", "R"), ("2", "A", "R", "R"), ("3", "B", "R", "R")], "codeno string, codenamea string, codenameb string, codenamec string")
    assert {r["term"] for r in taxonomy.expand(t).filter("code = '2'").collect()} == {"A", "R"}
    assert {r["term"] for r in taxonomy.expand(t, 2).filter("code = '2'").collect()} == {"A", "B", "R"}
    assert rows(taxonomy.reverse(taxonomy.expand(t)), "term", "codes") == [("A", ["1", "2"]), ("B", ["1", "3"]), ("R", ["1", "2", "3"])]


def test_unknown_code_matches_nothing(spark):
    t = spark.createDataFrame([("1", "A", "A", "A")], "codeno string, codenamea string, codenameb string, codenamec string")
    r = spark.createDataFrame([("a", ["1"]), ("b", ["1", "9"]), ("c", [])], "qid string, codes array<string>")
    assert rows(taxonomy.resolve(r, taxonomy.expand(t)), "qid", "terms") == [("a", ["A"]), ("b", None), ("c", [])]


def test_dense_on_eligible_rows(spark):
    v = spark.createDataFrame([(1, [0.2, 0.0]), (2, [1.0, 0.0]), (3, [0.8, 0.0])], "doc int, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, qvec array<float>")
    e = spark.createDataFrame([(1,), (3,)], "doc int")
    got = dense.exact_top_k(q, v, 2, e).orderBy("rank").collect()
    assert [(r["doc"], r["rank"]) for r in got] == [(3, 1), (1, 2)]


def test_graph_weights(spark):
    m = spark.createDataFrame([(1, "d", "python", "language"), (2, "d", "python", "language"), (3, "d", "python", "tool"), (1, "d", "sql", "query"), (2, "d", "sql", "query"), (3, "d", "once", "x")], "record int, duty string, skill string, category string")
    r = spark.createDataFrame([(1, "python", "USED_WITH", "sql"), (2, "python", "USED_WITH", "sql"), (2, "python", "LIKES", "sql"), (3, "once", "USED_WITH", "python")], "record int, source string, type string, target string")
    got = graph.skill_relations(r, m, 2).collect()
    assert [(x["source"], x["target"], x["support"]) for x in got] == [("python", "sql", 2)] and got[0]["weight"] == pytest.approx(2 / math.sqrt(6))
    assert rows(graph.category_majority(m), "skill", "category")[1] == ("python", "language")
    assert rows(graph.category_conflicts(m), "skill", "categories", "mentions") == [("python", 2, 3)]
    assert rows(graph.duty_skills(m, 2).withColumn("weight", F.round("weight", 6)), "skill", "weight") == [("python", 1.0), ("sql", 0.666667)]


def _fused(spark, base, hits):
    b = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(base)], "qid string, doc long, rank int")
    h = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(hits)], "qid string, doc long, rank int")
    g = graph.graph_ranks(h.withColumn("bridge", F.lit("x")).withColumn("strength", F.lit(0.9)))
    return [r["doc"] for r in graph.protect(graph.fuse(b, g)).orderBy("rank").collect()]


def test_fused_order_keeps_the_head(spark):
    assert _fused(spark, list(range(1, 11)), [9, 20])[:10] == [1, 2, 3, 9, 20, 4, 5, 6, 7, 8]


def test_few_novel_rows_enter_a_full_top_ten(spark):
    got = _fused(spark, list(range(1, 11)), [201, 202, 203])
    assert sum(d > 200 for d in got[:10]) == 2 and set(got) == {*range(1, 11), 201, 202, 203}


def test_a_short_baseline_is_filled_with_novel_rows(spark):
    got = _fused(spark, [101, 102], [201, 202, 203, 204, 205])
    assert sum(d > 200 for d in got[:10]) == 5 and got[:2] == [101, 102]


def test_alias_needs_its_whole_word(spark):
    a = spark.createDataFrame([("go", "go"), ("google cloud", "gcp"), ("雲端", "cloud")], "alias string, skill string")
    q = spark.createDataFrame([("1", "google cloud", ["google", "cloud"]), ("2", "go engineer", ["go", "engineer"]), ("3", "雲端工程師", ["雲端"])], "qid string, text string, tokens array<string>")
    assert rows(graph.alias_anchors(q, a), "qid", "skill") == [("1", "gcp"), ("2", "go"), ("3", "cloud")]


def test_anchors_prefer_priority_over_strength(spark):
    a = spark.createDataFrame([("q", "x", 0, 0.1), ("q", "x", 1, 0.9), ("q", "y", 1, 0.5)], "qid string, skill string, priority int, strength double")
    assert rows(graph.select_anchors(a), "skill", "priority", "strength") == [("x", 0, 0.1), ("y", 1, 0.5)]


def test_merge_and_revalidation(spark):
    c = spark.createDataFrame([("q", "bm25", True, "1", 9.0, 1), ("q", "dense", False, "2", 9.0, 1), ("q", "dense", False, "1", 8.0, 2)], "qid string, lane string, required boolean, doc string, score double, rank int")
    meta = spark.createDataFrame([("1", ["a"], ["d"], 100), ("2", ["b"], ["d"], 5)], "doc string, location_codes array<string>, duty_codes array<string>, updated_ms long").withColumn("updated", F.lit("2026-06-10").cast("timestamp_ntz"))
    r = spark.createDataFrame([("q", ["a"], [], 50)], "qid string, locations array<string>, duties array<string>, minimum_ms long")
    checked = engine.revalidate(c, meta, r)
    assert rows(checked.filter("violation is not null"), "doc", "violation") == [("2", "stale")]
    assert {x["doc"] for x in engine.enforce(checked).collect()} == {"1"}
    m = engine.merge(c, meta, F.lit("2026-06-09").cast("timestamp_ntz")).orderBy("position").collect()
    assert [(x["doc"], x["contribution"], x["future"], x["freshness"]) for x in m] == [("1", 9.0, True, 0.0), ("2", 0.0, True, 0.0)]
    assert '"status":"disabled"' in engine.audit_trace(engine.merge(c, meta, F.lit("2026-06-09").cast("timestamp_ntz"))).first()["trace"]


def test_required_lane_violation_is_an_error(spark):
    c = spark.createDataFrame([("q", True, "stale")], "qid string, required boolean, violation string")
    with pytest.raises(Exception, match="required lane violates filter"):
        engine.enforce(c).collect()


def test_lane_contract(spark):
    good = [("q", "l", "1", 2.0, 1), ("q", "l", "2", 1.0, 2)]
    bad = [("r", "l", "01x", 1.0, 1), ("r", "l", "2", 3.0, 3)]
    df = spark.createDataFrame(good + bad, "qid string, lane string, doc string, score double, rank int")
    assert rows(engine.lane_violations(df), "qid", "rule") == [("r", "rank not contiguous"), ("r", "score rises"), ("r", "unsafe id")]


def test_corrections(spark):
    p = spark.createDataFrame([("kuberntes", "kubernetes")] * 2 + [("a", "b"), ("a", "c"), ("a", "b"), ("same", "same")], "surface string, target string")
    assert rows(engine.mine_corrections(p, 2), "source", "target", "support") == [("kuberntes", "kubernetes", 2)]
    m = F.create_map(F.lit("kuberntes"), F.lit("kubernetes"))
    assert spark.createDataFrame([("kuberntes job",)], "t string").select(engine.rewrite(F.col("t"), m)).first()[0] == ["kuberntes job", "kubernetes job"]


def test_quotas():
    assert sampling.quotas({"rare": 1, "common": 100}, 5) == {"rare": 1, "common": 4}
    q = sampling.quotas({"a": 3, "b": 50, "c": 900}, 60)
    assert sum(q.values()) == 60 and q["a"] <= 3
    assert sampling.quotas({"a": 2, "b": 2, "c": 2}, 4) == {"a": 2, "b": 1, "c": 1}  # the rest goes to the largest, ties by name
    assert sampling.quotas({"a": 1, "b": 2}, 100) == {"a": 1, "b": 2}
    assert sampling.quotas({}, 5) == {}
    with pytest.raises(ValueError):
        sampling.quotas({"a": 1, "b": 1}, 1)
    with pytest.raises(ValueError):
        sampling.quotas({"a": 1}, 0)


def test_sample_is_the_same_for_any_partitioning(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "k int, s string")
    pick = lambda x: rows(sampling.hash_sample(x, "s", "k", 10, "seed"), "k")
    assert pick(d) == pick(d.repartition(7)) and len(pick(d)) == 10


def test_trec(spark):
    r = spark.createDataFrame([("q", 5, 1), ("q", 7, 2)], "qid string, doc int, rank int")
    lines = evaluate.trec_rows(r, "t").orderBy("rank").select("line")
    assert [x[0] for x in lines.collect()] == ["q Q0 5 1 2.000000000000 t", "q Q0 7 2 1.000000000000 t"]
    assert evaluate.trec_violations(evaluate.parse_trec(lines)).count() == 0
    bad = spark.createDataFrame([("bad/qid Q0 5 1 1 t",), ("q Q0 job-101 1 1 t",), ("z Q0 0101 1 1 t",)], "line string")
    assert {x["rule"] for x in evaluate.trec_violations(evaluate.parse_trec(bad)).collect()} == {"malformed"}


def test_metrics(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3)], "qid string, doc int, rank int")
    rel = spark.createDataFrame([("q", 2, 1), ("q", 9, 1), ("z", 1, 1)], "qid string, doc int, grade int")
    m = {r["qid"]: r for r in evaluate.metrics(run, rel).collect()}
    assert m["q"]["mrr"] == 0.5 and m["q"]["recall_100"] == 0.5 and m["q"]["precision_10"] == pytest.approx(0.1) and m["z"]["ndcg_10"] == 0
    assert m["q"]["ndcg_10"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_audits(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert rows(audit.difference(a, a.dropDuplicates()), "side", "k") == [("only_first", 1)]
    n = audit.numbered(spark.range(50).select((F.col("id") * 7 % 50).alias("id")), [F.col("id")])
    assert all(r["id"] == r["row_number"] for r in n.collect())
    d = spark.createDataFrame([(1, 5, "old"), (1, 9, "new"), (2, 1, "only")], "k int, t int, v string")
    assert rows(audit.latest(d, "k", [F.col("t")]), "k", "v") == [(1, "new"), (2, "only")]
    g = spark.createDataFrame([(0, 5), (5, 9), (10, 12)], "a int, b int")
    assert rows(audit.gaps(g, "a", "b"), "a") == [(10,)]
    o = spark.createDataFrame([("a/1",), ("b/1",)], "path string")
    p = spark.createDataFrame([("a/",), ("c/",)], "prefix string")
    assert rows(audit.inventory_rules(o, p), "path", "n_rules") == [("b/1", 0)] and rows(audit.unused_rules(o, p), "prefix") == [("c/",)]


def test_path_traces_keep_the_best(spark):
    e = spark.createDataFrame([("q", f"a{i}", "b", 1.0, f"a{i}", "USED_WITH", "b", 0.1 * (i + 1)) for i in range(7)], "qid string, skill string, related string, strength double, source string, type string, target string, weight double")
    h = spark.createDataFrame([("q", "b", 1, 1)], "qid string, bridge string, doc int, rank int")
    s = spark.createDataFrame([("a6", "USED_WITH", "b", f"span{i}") for i in range(5)], "source string, type string, target string, span string")
    t = graph.path_traces(e, h, s).first()
    assert (t["total"], t["retained"], t["omitted"]) == (7, 5, 2) and t["paths"][0]["anchor"] == "a6" and t["paths"][0]["spans"] == ["span0", "span1", "span2"]


def test_evidence_rules(spark):
    e = spark.createDataFrame([(1, "uses python daily", "python", "uses python"), (2, "uses sql", "java", "uses sql"), (3, "x", "x", "y")], "record int, source_text string, surface string, span string")
    assert rows(graph.evidence_violations(e), "record", "rule") == [(2, "surface outside span"), (3, "span outside text"), (3, "surface outside span")]


def test_extraction_is_held_against_the_text(spark):
    def client(text):
        return {
            "skills": [{"canonical_name": n, "surface": f, "category": "c", "evidence_span": e} for n, f, e in [("python", "Python", "uses Python"), ("python", "Python", "uses Python"), ("java", "Java", "uses Python"), ("sql", "SQL", "SQL daily"), ("x", "y", "not there")]],
            "relations": [{"source": a, "type": t, "target": b, "evidence_span": "uses Python"} for a, t, b in [("python", "USED_WITH", "sql"), ("python", "LIKES", "sql"), ("python", "USED_WITH", "python"), ("python", "USED_WITH", "java")]],
        }

    req = spark.createDataFrame([("r1", "uses Python and SQL daily"), ("r2", "done")], "record_id string, source_text string")
    todo = extraction.pending(req, spark.createDataFrame([("r2",)], "record_id string"))
    r = extraction.validated(extraction.extract(todo, client)).collect()
    assert len(r) == 1 and [s["canonical_name"] for s in r[0]["skills"]] == ["python", "sql"] and len(r[0]["relations"]) == 1
    assert (r[0]["skill_rejection_count"], r[0]["relation_rejection_count"]) == (3, 3)


def test_gate_and_retries():
    assert extraction.approved(0.01, 0.005, True, True) and not extraction.approved(0.01, 0.005, True, False) and not extraction.approved(0.0, 0.0, True, True)
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("Timeout")
        return "ok"

    assert extraction.retried(flaky, wait=waits.append)() == "ok" and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        extraction.retried(lambda: (_ for _ in ()).throw(ValueError("bad input")), wait=waits.append)()


def test_path_rules(spark):
    o = spark.createDataFrame([("a/secret-key.json",), ("b/secretary.txt",)], "path string")
    assert rows(extraction.forbidden_paths(o, ["secret"]), "path") == [("a/secret-key.json",)]
    assert rows(extraction.required_artifacts(o, spark.createDataFrame([("b/",)], "prefix string")), "path") == [("b/secretary.txt",)]


def test_contiguity_and_rebuild(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 1), ("c", 1)], "k string, n int")
    assert rows(audit.not_contiguous(d, ["k"], "n"), "k") == [("b",), ("c",)]
    assert audit.rebuilt_equals_stored({"t": d}, {"t": d.repartition(2)}) == {"t": 0}
    assert audit.rebuilt_equals_stored({"t": d}, {"t": d.distinct()}) == {"t": 1}


def test_details(spark):
    r = spark.createDataFrame([("q", 1), ("q", 2)], "qid string, doc int")
    det = spark.createDataFrame([(1, "x")], "doc int, text string")
    assert rows(engine.with_details(r, det), "doc", "missing") == [(1, 1), (2, 1)]
    with pytest.raises(Exception, match="no details at all"):
        engine.with_details(r, det.filter("doc = 9")).collect()


def test_batched_dense_keeps_the_smallest_of_many_copies(spark):
    v = np.random.RandomState(1).randn(24).tolist()
    rows = [(i, v) for i in range(300)] + [(1_000 + i, [2 * x for x in v]) for i in range(2)]
    d = spark.createDataFrame(rows, "doc long, vec array<double>").repartition(3)
    q = spark.createDataFrame([("a", v), ("b", [-x for x in v])], "qid string, qvec array<double>")
    got, want = ({(r["qid"], r["doc"], r["rank"]) for r in f(q, d, 5).collect()} for f in (dense.batched_top_k, dense.exact_top_k))
    assert got == want
