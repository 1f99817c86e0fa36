from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.operators import multivalue as mv
from lodeline.operators import pay_units as pay

NAMES = {"Python", "SQL", "C/C++", "TCP/IP", "SQL Server", "Excel", "Word", "Power BI", "Java", "A/B測試"}
STRONG = ["、", "，", ",", "；", ";", "|", "｜", "／", " / ", "\t", "\n"]
BLANKS = ["/", " ", "　"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Python、SQL", ["Python", "SQL"]),
        ("Python/SQL/Excel", ["Python", "SQL", "Excel"]),
        ("C/C++ / TCP/IP", ["C/C++", "TCP/IP"]),
        ("Word/迅貨通", ["Word/迅貨通"]),
        ("SQL Server Power BI Java", ["SQL Server", "Power BI", "Java"]),
        ("1. Python 2. “Word, Excel 整合應用” 3. Java", ["Python", "Word, Excel 整合應用", "Java"]),
        ("(1)Python；(2)SQL", ["Python", "SQL"]),
        ("1、Excel；2、\"備份;還原工具\"", ["Excel", "備份;還原工具"]),
        ('["Word, Excel 整合應用", "Python"]', ["Word, Excel 整合應用", "Python"]),
        ("{Python,SQL}", ["Python", "SQL"]),
        ("Office(Word, Excel)、Python", ["Office(Word, Excel)", "Python"]),
        ("● A/B測試\n● 文書處理（公文；信函）", ["A/B測試", "文書處理（公文；信函）"]),
        ("Python,,Python,", ["Python", "Python"]),
        ("- Python", ["Python"]),
        ("'訪談;紀錄'、Python", ["訪談;紀錄", "Python"]),
        ('"unclosed、Python', ['"unclosed', "Python"]),
        ("不拘", []),
        ("N/A", []),
        ("", []),
        (None, []),
        ("-", []),
    ],
)
def test_split(text, expected):
    assert mv.split(text, NAMES, STRONG, BLANKS) == expected


def test_long_field_is_kept_whole():
    assert len(mv.split("、".join(f"v{i}" for i in range(5_000)), NAMES, STRONG, BLANKS)) == 5_000


def test_inference_and_rows(spark):
    data = [(i, t, None) for i, t in enumerate(["Python、SQL", "Python、Excel、Java", "Power BI", "C/C++", "無", "TCP/IP、Word", None, "Python、SQL"])]
    raw = spark.createDataFrame(data, "source_row long, f string, val string")  # a column named like an output
    long = mv.fields_long(raw.withColumn("source", F.lit("")), ["f"], "source")
    scores = {r["sign"]: r["score"] for r in mv.inferred(long, NAMES).collect()}
    assert scores["、"] == 1.0 and " " not in scores
    got = sorted(tuple(r) for r in mv.split_fields(raw, ["f"], NAMES).collect())
    assert got[0] == (0, "f", 1, "Python") and got[-1] == (7, "f", 2, "SQL") and len(got) == 11
    assert mv.split_fields(raw.limit(0), ["f"], NAMES).count() == 0


def test_signs_are_inferred_by_source(spark):
    """One sign separates at one source and stands inside values at another; a sign of spelling separates names at a third."""
    rows = []
    for i in range(60):
        rows += [("a", ["Python|SQL", "SQL|Excel|Java", "Word|Python"][i % 3]), ("b", f"規格{i}|型號{i}"), ("c", ["Python+SQL", "Excel+Java", "Word+SQL+Java"][i % 3]), ("d", "C/C++、TCP/IP")]
    raw = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "source_row long, f string, source string")
    scores = {(r["source"], r["sign"]): r["accepted"] for r in mv.inferred(mv.fields_long(raw, ["f"], "source"), NAMES).collect()}
    assert scores["a", "|"] and not scores["b", "|"] and scores["c", "+"] and ("d", "+") not in scores
    got = {(r["source_row"], r["pos"]): r["val"] for r in mv.split_fields(raw, ["f"], NAMES).collect()}
    assert (got[0, 1], got[0, 2], got[1, 1], got[2, 1], got[2, 2], got[3, 1], got[3, 2]) == ("Python", "SQL", "規格0|型號0", "Python", "SQL", "C/C++", "TCP/IP") and (1, 2) not in got


def test_piece_counts_decide(spark):
    """A sign whose cuts give other numbers of pieces than the values seen is refused although its sides look regular."""
    known = mv.Names(NAMES)
    assert mv.evidence("Python、SQL", known)["、"] == (2, 2, 1, 1)
    assert mv.evidence("規格、型號", known)["、"] == (2, 0, 1, 0)
    assert mv.evidence("Python;;SQL;", known)[";"][2:] == (1, 1)
    assert mv.evidence("C/C++", known) == {} and mv.evidence("SQL Server Java", known)[" "] == (2, 2, 1, 1)
    assert [b - a for a, b in known.spans("SQL Server、「Word」(Excel) Javas")] == [10, 6]


def test_sources_of_rows(spark):
    raw = spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, id string")
    origin = spark.createDataFrame([("a", "v1"), ("a", "v2"), (None, "v3"), ("b", "v4")], "id string, vendor string")
    assert sorted((r["k"], r["source"]) for r in mv.with_source(raw, origin, "id", "vendor").collect()) == [(1, "v1"), (2, ""), (3, "")]


@pytest.mark.parametrize(
    ("text", "low", "high", "period", "currency"),
    [
        ("月薪 2.9 萬元", 29000, 29000, "month", "TWD"),
        ("年收：253萬~351萬元", 2530000, 3510000, "year", "TWD"),
        ("３７０００～４２０００元 per month", 37000, 42000, "month", "TWD"),
        ("月薪：3.4到5.4萬", 34000, 54000, "month", None),
        ("月薪 八萬–一十一萬六千元", 80000, 116000, "month", "TWD"),
        ("TWD 5萬7千 - 9萬／月", 57000, 90000, "month", "TWD"),
        ("底薪 52800封頂", 0, 52800, "month", None),
        ("77K+／月", 77000, 0, "month", None),
        ("每月 36K~44K", 36000, 44000, "month", None),
        ("TWD 29～42 K/月", 29000, 42000, "month", "TWD"),
        ("底薪250,000到300,000日圓", 250000, 300000, "month", "JPY"),
        ("每月 70,900元整以下，另有年終2個月", 0, 70900, "month", "TWD"),
        ("鐘點費 315～390元整；滿3個月調薪", 315, 390, "hour", "TWD"),
        ("面議（月薪 ２９２００元整）", 29200, 29200, "month", "TWD"),
        ("900美元以內/月", 0, 900, "month", "USD"),
        ("年薪：一百七十二萬元整", 1720000, 1720000, "year", "TWD"),
    ],
)
def test_amounts_in_text(text, low, high, period, currency):
    r = pay.read_text(text)
    assert (r["low"], r["high"], r["period"], r["currency"]) == (low, high, period, currency)


@pytest.mark.parametrize("text", ["面議", "比照2026年薪級表", "論件計酬", "依公司規定", "Negotiable", "", None])
def test_texts_without_amount(text):
    assert pay.observation(text, Decimal("0.00"), Decimal("0.00")) is None and pay.observation(text, None, None) is None


def test_numbers_hold_in_the_named_unit():
    o = pay.observation("月薪/千元", Decimal("66.00"), None)
    assert (o["low"], o["high"], o["scale"], o["currency"]) == (66, 0, "thousand", "TWD")
    assert pay.observation("底薪/日圓", Decimal(1), Decimal(2))["period"] == "month"


def test_viterbi_finds_the_unit_switch():
    logs = np.log([1.0, 1000.0])
    amounts = np.array([50_000, 51_000, 52, 50, 49_000.0])
    assert pay.viterbi(np.log(amounts)[:, None] + logs[None, :], np.ones((5, 2), bool) & np.array([[True, False]] + [[True, True]] * 4)).tolist() == [0, 0, 1, 1, 0]


def test_half_up():
    assert [pay.half_up(Fraction(x)) for x in ("1/2", "3/2", "5/4")] == [1, 2, 1]


def test_monthly_pay(spark):
    units = spark.createDataFrame([("period", "hour", 176, 1), ("period", "day", 22, 1), ("period", "month", 1, 1), ("period", "year", 1, 12), ("currency", "TWD", 1, 1), ("currency", "USD", 63, 2), ("currency", "JPY", 21, 100), ("currency", "CNY", 22, 5), ("scale", "one", 1, 1), ("scale", "thousand", 1000, 1), ("scale", "ten_thousand", 10000, 1)], "unit_kind string, unit_code string, numer long, denom long")
    data = [("1", "時薪 200元", None, None, "v"), ("2", "年薪/萬元", Decimal(120), Decimal(60), "v"), ("3", "面議", Decimal(0), None, "v"), ("4", None, None, None, None), ("5", "每月 1300–1800美元", None, None, None), ("6", "52000", None, None, "v")]
    jobs = spark.createDataFrame([(*r, None) for r in data], "job_id string, salary_text string, salary_min decimal(12,2), salary_max decimal(12,2), vendor_id string, source_modified_at timestamp")
    got = sorted((r["job_id"], r["min_twd_month"], r["max_twd_month"]) for r in pay.monthly_pay(jobs, units).collect())
    assert got == [("1", 35200, 35200), ("2", 50000, 100000), ("5", 40950, 56700), ("6", 52000, 52000)]
    assert pay.monthly_pay(jobs.limit(0), units).count() == 0


def test_sequences_are_cut_by_time_with_a_lead(spark):
    rows = [("v", f"2026-01-{1 + i // 24:02d} {i % 24:02d}:00:00", str(i)) for i in range(60)] + [("v", "2026-02-01 05:10:00", f"h{i}") for i in range(25)] + [("v", "2026-02-02 00:00:00", "z"), ("w", None, "n")]
    got = pay.sequences(spark.createDataFrame(rows, "source string, time string, job_id string"), 10).toPandas()
    own = got[~got.lead]
    assert sorted(own.job_id) == sorted(r[2] for r in rows)  # every row once
    sizes = own[own.job_id.str.isdigit()].groupby("part").size()
    assert len(sizes) == 6 and sizes.max() == 10
    hot = own[own.job_id.str.startswith("h")].groupby("part").size()
    assert len(hot) == 3 and hot.sum() == 25  # one hour of more rows than a sequence
    lead = got[got.lead]
    assert len(lead) and all(lead[lead.part == p].time.max() <= own[(own.part == p) & (own.source == "v")].time.min() for p in set(lead.part))


def test_too_many_units_are_refused(spark):
    units = spark.range(pay.MOST_UNITS + 1).selectExpr("'period' as unit_kind", "cast(id as string) as unit_code", "1L as numer", "1L as denom")
    with pytest.raises(ValueError):
        pay.unit_factors(units)
