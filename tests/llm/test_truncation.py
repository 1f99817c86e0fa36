import random

import numpy as np
import pytest

from lodeline.llm import truncation as tr

SENTENCES = ["處理排班表，落實交接與備份。", "具良好溝通與表達能力。", "福利：三節禮金、旅遊補助。", "Maintain the nightly data load for roughly 12 stores. ", "細心負責且守時。", "整理訂單交期，每季至少提出3項改善。", "Review shift rosters and keep the backlog under 40 items. "]
CLOSINGS = ["以上", "EOE", "聯絡窗口：人資部 分機 123", "薪資：面議"]


def _corpus(n=1_500, seed=5):
    r = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t = "".join(r.choice(SENTENCES) for _ in range(r.randrange(5, 25))) + (r.choice(CLOSINGS) if r.random() < 0.3 else "")
        source = r.choice(["limit", "plain", None])
        if source == "limit" and len(t) > 200:
            t = t[:200]
            if t.rstrip()[-1] not in "。." and not t.endswith(tuple(CLOSINGS)):
                cut.add(i)
        elif source == "plain" and r.random() < 0.08:
            t = t[: t.rindex("。") - 2] + "<sp" if r.random() < 0.3 else t[: t.rindex("，") + 1] if "，" in t else t
            if t[-1] in "，p":
                cut.add(i)
        rows.append((i, source, t))
    return rows, cut


def test_found_in_a_corpus(spark):
    rows, cut = _corpus()
    got = {r["doc_id"] for r in tr.found(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)


def test_the_limit_is_found_and_reported(spark):
    rows, _ = _corpus()
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lengths = {(r["source"], r["length"]) for r in tr.cutting_lengths(tr.endings(d)).collect()}
    assert ("limit", 200) in lengths
    rep = {r["source"]: r for r in tr.report(d).collect()}
    assert rep["limit"]["share"] > 0.2 and rep[None]["cut_documents"] == 0 and sum(r["documents"] for r in rep.values()) == 1_500


@pytest.mark.parametrize(
    ("text", "state"),
    [(None, "whole"), ("", "whole"), (" 　\n", "whole"), ("完成。", "whole"), ("完成。</div>\n", "whole"), ("完成。&nbsp;", "whole"), ("完成<span cla", "cut"), ("完成&nb", "cut"), ("內容�", "cut"), ("提出，", "cut"), ("福利：", "cut"), ("處理", "ask"), ("處理...", "mark"), ("處理…", "mark"), ("以上", "ask"), ("完成。…", "whole"), ("a" * 100_000, "ask")],
)
def test_endings(text, state):
    assert tr.ending(text)[0] == state


def test_run_keys_stop_at_the_sentence_start():
    a, b, c = (tr.run_keys(tr.codes(t)) for t in ("\x01abc", "xyz\x03abc", "zbc"))
    assert a[10][-1] == b[10][-1] and a[2][-1] == c[2][-1] and a[3][-1] != c[3][-1] and a[5][-1] != tr.run_keys(tr.codes("abc"))[5][-1]
    assert len({int(a[k][-1]) for k in tr.RUNS}) == len(tr.RUNS)


def test_last_sentence_equals_that_of_the_whole_text():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice(["abc", "。", "\n", "字" * 90, ". ", "長" * 700, "1.5", "•", "？"]) for _ in range(r.randrange(1, 12)))
        s = tr.skeleton(t).replace("\x03", "\x01").rstrip("\x01")
        assert tr.last_sentence(t) == (s[s.rfind("\x01") :] if s else "")


@pytest.mark.parametrize(
    ("text", "expected"),
    [('文字<img alt="x" src="data:image/png;base64,' + "A" * 5_000, True), ("文字<div style='color: red; " + "x: y; " * 2_000, True), ("a < b 而且" + "很長的文字" * 100, False), ("若 <b 且" + "很長的文字，" * 100 + "完", False), ("完成<sp", True), ("完成<b>粗</b>", False), ("x" * 300 + "&#12", True)],
)
def test_broken_markup_of_any_length(text, expected):
    assert tr.broken(text) is expected


def test_the_significant_length_decides(spark):
    """An ending that goes on elsewhere in some cases only is a cut at a significant length and none at another."""
    r = random.Random(8)
    body = lambda n: "".join(r.choice(SENTENCES) for _ in range(60))[: n - 4] + "。"
    rows = [(i, "limit", body(300) + "甲乙丙") for i in range(60)]
    rows += [(1_000 + i, "limit", body(150 + i % 140)) for i in range(400)]
    rows += [(2_000 + i, "plain", f"{i:03d}。甲乙丙丁戊。") for i in range(100)] + [(3_000 + i, "plain", f"{i:03d}。甲乙丙\n完。") for i in range(20)]
    rows += [(4_000 + i, "plain", body(310 + i) + "甲乙丙") for i in range(30)]
    out = tr.judged(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    assert set(out[out.cut].doc_id) == set(range(60)) and set(out[out.cut].by) == {"length"}


def test_empty_table_and_repeated_rows(spark):
    d = spark.createDataFrame([(1, "s", "提出，", 1), (1, "s", "提出，", 1), (2, "s", None, 1)], "doc_id long, source string, text string, cut int")
    assert [r["doc_id"] for r in tr.found(d).collect()] == [1] and tr.found(d.limit(0)).count() == 0
    assert tr.report(d).first()["cut_documents"] == 2


@pytest.mark.parametrize("copies", [1, 4, 800])
def test_a_cut_text_that_is_sent_again_is_judged_as_if_sent_once(spark, copies):
    rows, _ = _corpus()
    text = "".join(SENTENCES[:3]) + "夜班協助整理訂單交"  # the last run of ten occurs nowhere else, the shorter ones go on
    again = [(10_000 + i, "plain", text) for i in range(copies)]
    d = spark.createDataFrame(rows + again, "doc_id long, source string, text string").repartition(5)
    assert {r["doc_id"] for r in tr.found(d).filter("doc_id >= 10000").collect()} == {i for i, *_ in again}
    assert sorted(r["text"] for r in tr.distinct_texts(d, tr.endings(d)).collect()) == sorted({t for *_, t in rows + again})


def test_a_length_is_tested_against_the_hazard_of_its_neighbours(spark):
    ends = [101 + i for i in range(100)] + [200] * 100
    d = spark.createDataFrame([(i, "s", f"{i:05d}".ljust(n, "a")) for i, n in enumerate(ends)], "doc_id long, source string, text string")
    got = {(r["unit"], r["length"]): r for r in tr.cutting_lengths(tr.endings(d)).collect()}
    around = [n for n in range(200 - tr.NEAR, 200 + tr.NEAR + 1) if abs(n - 200) > tr.GAP]
    hazard = (sum(e in around for e in ends) + 0.5) / sum(e >= n for n in around for e in ends)
    assert set(got) == {("chars", 200), ("bytes", 200)} and got["chars", 200]["n"] == 101
    assert abs(got["chars", 200]["expected"] - 101 * hazard) < 1e-5
