import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeline.operators import engine, evaluate, graph, lexical, loads, taxonomy
from lodeline.plans import loading
from lodeline.runtime import settled


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_job_orders(spark):
    a = spark.createDataFrame([(0, "10"), (1, "x"), (3, "10")], "i long, id string")
    assert _rows(loads.job_order_breaches(a, "i", "id")) == [("gaps", "1"), ("repeated id", "10"), ("unsafe id", "x")]
    b = spark.createDataFrame([(0, "10"), (1, "11")], "i long, id string")
    assert sorted(tuple(r) for r in loads.order_differences(a, b, "i", "id").collect()) == [(1, "x", "11"), (3, "10", None)]
    assert loads.order_differences(b, b, "i", "id").isEmpty()


def test_corrections_are_loaded_only_if_all_holds(spark):
    rules = spark.createDataFrame([("enginer", "engineer")], "source string, target string")
    manifest = {**loads.CORRECTION_FLAGS, "max_source_timestamp": "2026-01-01", "train_cutoff_exclusive": "2026-02-01"}
    promotion = {**loads.PROMOTION_FLAGS, "absolute_delta": 0.01}
    assert loads.load_corrections(rules, manifest, promotion, F.lower).count() == 1
    bad = [
        (rules, {**manifest, "test_jd_used": True}, promotion), (rules, manifest, {**promotion, "absolute_delta": 0}), (rules, {**manifest, "max_source_timestamp": "2026-03-01"}, promotion),
        (spark.createDataFrame([("A", "a")], rules.schema), manifest, promotion), (rules.limit(0), manifest, promotion), (rules, manifest, {**promotion, "significant": False}),
    ]
    for r, m, p in bad:
        with pytest.raises(ValueError):
            loads.load_corrections(r, m, p, F.lower)


def test_visibility_and_counts_are_guarded(spark):
    d = spark.createDataFrame([("1",), ("0",)], "v string")
    assert loads.visible_only(d, "v").count() == 1
    with pytest.raises(Exception, match="unknown visibility"):
        loads.visible_only(d.unionByName(spark.createDataFrame([("2",)], "v string")), "v").collect()
    e = spark.createDataFrame([("q", 1), ("q", 2), ("r", 1)], "qid string, doc int")
    assert _rows(loads.eligible_counts(e, 2)) == [("q", 2), ("r", 1)]
    with pytest.raises(Exception, match="too many eligible"):
        loads.eligible_counts(e, 1).collect()


def test_any_number_of_eligible_documents_is_counted(spark, tmp_path):
    """The query's SQL counts all: 600,000 events of which one request takes every one."""
    e = spark.range(600_000).selectExpr("id as event_id", "timestamp_ntz'2024-02-01 00:00:00' as ts", "1L as user_id", "'view' as event_type", "2.0 as value")
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert _rows(loading.eligible_counts(spark, str(tmp_path))) == [("e1", 600_000), ("e2", 600_000)]


def test_children_of_a_path(spark):
    t = spark.createDataFrame([("1", "top", "top", "top"), ("2", "mid", "mid", "top"), ("3", "leaf", "mid", "top"), ("4", "leaf2", "mid2", "top")], "codeno string, codenamea string, codenameb string, codenamec string")
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, taxonomy.children(t, []).collect()), key=key) == [("top", "1", True)]
    assert sorted(map(tuple, taxonomy.children(t, ["top"]).collect()), key=key) == [("top/mid", "2", True), ("top/mid2", None, True)]
    assert sorted(map(tuple, taxonomy.children(t, ["top", "mid"]).collect()), key=key) == [("top/mid/leaf", "3", False)]


def test_an_optional_lane_that_fails_is_empty(spark):
    cols = "qid string, lane string, required boolean, doc string, score double, rank int"
    good, bad = ("q", "a", True, "1", 2.0, 1), ("q", "b", False, "x", 1.0, 1)
    kept, failed = engine.lanes_kept(spark.createDataFrame([good, bad], cols))
    assert [r["lane"] for r in kept.collect()] == ["a"] and _rows(failed) == [("q", "b", "shadow_lane_failed")]
    with pytest.raises(Exception, match="required lane failed"):
        engine.lanes_kept(spark.createDataFrame([("q", "a", True, "x", 1.0, 1)], cols))[0].collect()

    def fails():
        raise RuntimeError("down")

    rows, lost = engine.collected(lambda: kept, {"dense": fails, "other": lambda: kept})
    assert rows.count() == 2 and list(lost) == ["dense"]
    with pytest.raises(RuntimeError):
        engine.collected(fails, {})
    with pytest.raises(ValueError):
        engine.merge(kept, kept, F.lit(1), 11)


@given(st.lists(st.sampled_from(["a", "b", "c", "dd"]), max_size=12))
@settings(max_examples=25, deadline=None)
def test_frequencies_within_a_document(spark, tokens):
    d = spark.createDataFrame([(tokens,)], "t array<string>")
    assert {r["term"]: r["tf"] for r in d.select(lexical.frequencies(F.col("t")).alias("f")).first()["f"]} == Counter(tokens)


def test_frequencies_of_a_long_document_take_no_square_of_its_length(spark):
    d = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(10_000)), lambda i: F.concat(F.lit("w"), (i % 3_000).cast("string"))).alias("t"))
    began = time.monotonic()
    got = {r["term"]: r["tf"] for r in d.select(F.explode(lexical.frequencies(F.col("t"))).alias("f")).select("f.*").collect()}
    assert got == Counter(f"w{i % 3_000}" for i in range(1, 10_001))
    assert time.monotonic() - began < 30  # the array was sorted again for each token: minutes


def test_filters_as_predicates_equal_the_eligible_set(spark):
    docs = spark.createDataFrame([(i, "xy"[i % 2], "mn"[i % 3 == 0], str(int(i % 5 > 0)), i * 10) for i in range(40)], "doc int, location string, duty string, visible string, updated_ms long")
    docs = docs.withColumn("tokens", F.array(F.lit("t"), F.concat(F.lit("u"), F.col("doc") % 4)))
    kept = ["location", "duty", "visible", "updated_ms"]
    index = lexical.build(lexical.token_fields(docs, {"body": F.col("tokens")}, kept=kept), kept=kept)
    r = spark.createDataFrame([("a", ["x"], [], 50), ("b", [], ["n"], 0), ("c", None, [], 0), ("d", [], [], 200), ("e", ["x", "x"], ["m", "n"], 0)], "qid string, locations array<string>, duties array<string>, minimum_ms long")
    q = r.select("qid", F.explode(F.array(F.lit("t"), F.lit("u1"))).alias("term"))
    by = lambda **k: sorted((x["qid"], x["doc"], round(x["score"], 9)) for x in lexical.score(q, index, **k).collect())
    got = by(requests=r)
    assert got == by(eligible=lexical.eligible_rows(docs, r)) and {g[0] for g in got} == {"a", "b", "d", "e"}
    assert lexical.eligible_rows(docs, r).count() == lexical.eligible_rows(docs, r).distinct().count()


def test_settled_rows_are_the_same_either_way(spark):
    d = spark.createDataFrame([(i, [f"{i}"], None) for i in range(30)], "a int, b array<string>, c double")
    key = lambda r: r["a"]
    assert sorted(settled(d, 100).collect(), key=key) == sorted(settled(d, 3).collect(), key=key) and settled(d, 100).schema == settled(d, 3).schema


def test_shards_without_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (1, [2.0]), (5000, [1.0, 1.0])], "job_index long, embedding array<float>")
    s = spark.createDataFrame([("p", 0, 3), ("q", 4990, 5001), ("r", 9, 9)], "vectors_path string, row_start long, row_end long")
    assert _rows(loads.shard_breaches(v, s, 2)) == [("p", "no vector", 1), ("p", "other length", 1), ("p", "several vectors", 1), ("q", "no vector", 10)]


def test_totals_of_a_run(spark):
    q = spark.createDataFrame([("a",), ("b",)], "qid string")
    one = spark.createDataFrame([("a", 1, 0)], "qid string, doc int, priority int")
    run = spark.createDataFrame([("a", 1, 1, None), ("a", 2, None, 1)], "qid string, doc int, graph_rank int, base_rank int")
    r = evaluate.generation_statistics(q, one, one, one, one, one, one.limit(0), run).first()
    assert (r["query_count"], r["baseline_rows"], r["graph_paths"], r["novel_graph_candidate_rows"], r["queries_with_query_exact_anchors"], r["queries_with_duty_filter_anchors"]) == (2, 1, 0, 1, 1, 0) and len(r) == 14


def test_trace_limit(spark):
    with pytest.raises(ValueError):
        graph.trace_skill(None, None, None, None, 0)
