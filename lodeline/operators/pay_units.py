"""Pay recorded in different units (problem 5): a hidden Markov model per source with the unit as hidden state.

Each posting gives an observation: the amount it states and what its text says about period, currency and scale. The states
are the 48 units (period, currency, scale); named parts leave only the states that agree. Within a source (vendor), in order of
time, Viterbi's algorithm finds the units that make the monthly pay in TWD run smoothly: a change of unit costs ``SWITCH``,
a jump of the log level d costs d^2 / (2 SIGMA^2). Where the text names the unit the state is certain and only
serves as level for its neighbours; postings that name no unit take the decoded one.

A source is cut into sequences of about ``SEQUENCE`` rows by time, at whole hours; each sequence starts with the rows of the hour before it, which only
serve as level. The rows of an hour that holds more are spread over several sequences by hash of the id, since their order says little. So one large
source isn't one task, and no sequence starts without a level. Conversion is exact (fractions of the unit table), halves round up.

Defined results: an amount in the text holds before the numbers; bonuses, terms and years are no pay; a posting that states no amount
gives no row; an end that isn't stated is 0; ends in the wrong order are exchanged; null texts, vendors and times are allowed; an empty table gives none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeline.runtime import bounded, materialize

SEQUENCE, SIGMA, SWITCH = 4_096, 0.6, 1.0
PERIODS, CURRENCIES, SCALES = ["hour", "day", "month", "year"], ["TWD", "USD", "JPY", "CNY"], ["one", "thousand", "ten_thousand"]
STATES = [(p, c, s) for p in PERIODS for c in CURRENCIES for s in SCALES]

_PERIOD = [
    ("hour", re.compile(r"時薪|每小時|每時|鐘點費|/\s*(?:小時|時|hr|hour|h\b)|per\s*hour|hourly|an hour", re.I)),
    ("day", re.compile(r"日薪|每日|每天|日領|/\s*(?:日(?![圓元幣])|天|day)|per\s*day|daily", re.I)),
    ("year", re.compile(r"年薪|每年|年收|/\s*(?:年|yr|year)|per\s*(?:year|annum)|p\.?a\.?(?![a-z])|annual", re.I)),
    ("month", re.compile(r"月薪|每月|底薪|/\s*(?:月|month|mo\b)|per\s*month|monthly", re.I)),
]
_CURRENCY = [
    ("USD", re.compile(r"美元|美金|USD|US\$", re.I)),
    ("JPY", re.compile(r"日圓|日元|日幣|円|JPY|¥", re.I)),
    ("CNY", re.compile(r"人民幣|CNY|RMB", re.I)),
    ("TWD", re.compile(r"NT\$|NTD|TWD|新台幣|台幣|元", re.I)),
]
_NOT_PAY = re.compile(r"[,;，；(（]?\s*(?:另有|另加|外加|滿\s*\d|試用|年終|獎金|分紅|三節)[^)）;]*[)）]?|比照.*|(?:19|20)\d\d\s*年(?!薪)")
_HAN = "零〇一二兩三四五六七八九十百千仟萬万"
_NUM = rf"(?:\d[\d,]*(?:\.\d+)?|[{_HAN}]*[一二兩三四五六七八九十][{_HAN}]*)"
_AMOUNT = re.compile(rf"({_NUM})\s*(?:([萬万])\s*(?:(\d+(?:\.\d+)?)\s*([千仟]))?|([千仟]|[kK](?![a-z])))?")
_RANGE = re.compile(r"\s*(?:[a-zA-Z$]{0,3}\s*)(?:元|美元|日圓|円|人民幣)?\s*(?:[-–—~～〜至到]|to)\s*", re.I)
_OPEN_UP = re.compile(r"以上|起|\+|\bup\b|至少|從", re.I)
_OPEN_DOWN = re.compile(r"以下|以內|封頂|為限|最高|\bmax\b", re.I)
_DIGIT = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "兩": 2}
_POWER = {"十": 10, "百": 100, "千": 1000, "仟": 1000}


def han_number(text: str) -> int:
    """A number in Chinese numerals, up to ten-thousands."""
    total = section = digit = 0
    for ch in text:
        if ch in _DIGIT:
            digit = _DIGIT[ch]
        elif ch in _POWER:
            section += (digit or 1) * _POWER[ch]
            digit = 0
        else:
            total += (section + digit) * 10_000
            section = digit = 0
    return total + section + digit


def plain(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _first(rules: list[tuple[str, re.Pattern]], text: str) -> str | None:
    return next((name for name, rule in rules if rule.search(text)), None)


def _value(m: re.Match) -> tuple[Fraction, bool]:
    """The amount and whether it carries a scale of its own."""
    number = m.group(1)
    if number[0].isdigit():
        value, scaled = Fraction(number.replace(",", "")), False
    else:
        value, scaled = Fraction(han_number(number)), True
    if m.group(2):
        value, scaled = value * 10_000, True
        if m.group(3):
            value += Fraction(m.group(3)) * 1_000
    elif m.group(5):
        value, scaled = value * 1_000, True
    return value, scaled


def read_text(text: str | None) -> dict:
    """What a pay text says: ``low, high`` (amounts, scale applied; None if there is none) and the parts of the unit named."""
    t = _NOT_PAY.sub(" ", plain(text or ""))
    said = {"period": _first(_PERIOD, t), "currency": _first(_CURRENCY, t), "scale": None, "low": None, "high": None}
    found = [m for m in _AMOUNT.finditer(t) if m.group(1).strip(",")]
    # a lone scale word, as in "unit: ten thousand", is no amount
    found = [m for m in found if m.group(1)[0].isdigit() or any(c in _DIGIT or c == "十" for c in m.group(1))]
    if not found:
        said["scale"] = "ten_thousand" if re.search("[萬万]", t) else "thousand" if re.search(r"[千仟]|\d*k(?![a-z])", t, re.I) else None
        return said
    a = found[0]
    low, scaled_low = _value(a)
    b = found[1] if len(found) > 1 and _RANGE.fullmatch(t[a.end() : found[1].start()]) else None
    if b is None:
        up, down = _OPEN_UP.search(t), _OPEN_DOWN.search(t)
        said["low"], said["high"] = (Fraction(0) if down and not up else low), (Fraction(0) if up else low)
        return said
    high, _ = _value(b)
    if not scaled_low and not a.group(2) and not a.group(5):  # a scale after the range holds for both ends
        if b.group(2):
            low *= 10_000
        elif b.group(5):
            low *= 1_000
    said["low"], said["high"] = min(low, high), max(low, high)
    return said


def observation(text: str | None, low: Decimal | None, high: Decimal | None) -> dict | None:
    """The stated amount with the named parts of its unit, or None if nothing is stated."""
    said = read_text(text)
    if said["low"] is not None:
        said["scale"] = "one"
    else:
        a, b = Fraction(low or 0), Fraction(high or 0)
        if a <= 0 and b <= 0:
            return None
        said["low"], said["high"] = (min(a, b), max(a, b)) if a > 0 and b > 0 else (max(a, 0), max(b, 0))
        if said["period"] or said["currency"] or said["scale"]:
            said["scale"] = said["scale"] or "one"
    if said["period"] or said["currency"] or said["scale"] not in (None, "one"):
        said["currency"] = said["currency"] or "TWD"
    return said


def viterbi(levels: np.ndarray, allowed: np.ndarray, sigma: float = SIGMA, switch: float = SWITCH) -> np.ndarray:
    """The best state of each row. levels: log of the amount in each state's unit; allowed: states that agree with the text."""
    n, s = levels.shape
    change = np.where(np.eye(s, dtype=bool), 0.0, switch)
    score = np.where(allowed[0], 0.0, np.inf)
    back = np.zeros((n, s), np.int32)
    for t in range(1, n):
        to, frm = np.flatnonzero(allowed[t]), np.flatnonzero(np.isfinite(score))
        cost = score[frm][:, None] + change[np.ix_(frm, to)] + (levels[t, to][None, :] - levels[t - 1, frm][:, None]) ** 2 / (2 * sigma * sigma)
        best = cost.argmin(0)
        nxt = np.full(s, np.inf)
        nxt[to] = cost[best, np.arange(len(to))]
        back[t, to] = frm[best]
        score = nxt
    out = np.zeros(n, np.int64)
    out[-1] = int(score.argmin())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def half_up(x: Fraction) -> int:
    return math.floor(x + Fraction(1, 2))


MOST_UNITS = 1_000


def unit_factors(units: DataFrame) -> dict[tuple[str, str], Fraction]:
    """The unit table (a fixed table of a few rows; more than ``MOST_UNITS`` are an error)."""
    rows = bounded(units.select("unit_kind", "unit_code", "numer", "denom"), MOST_UNITS, "units").collect()
    return {(r["unit_kind"], r["unit_code"]): Fraction(int(r["numer"]), int(r["denom"])) for r in rows}


def sequences(stated: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """``stated`` with ``part`` and ``lead`` (rows of the hour before a sequence). stated: ``source, time, job_id`` and more."""
    hour = F.coalesce(F.substring("time", 1, 13), F.lit(""))
    hours = stated.groupBy("source", hour.alias("hour")).agg(F.count("*").alias("n"))
    # an hour's place among the rows of its source, from counts by hour alone
    own = Window.partitionBy("source").orderBy("hour")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = F.ceil(F.col("n") / most).cast("int")
    ranked = hours.withColumn("step", F.floor(before / most) + F.sum(F.when(spread > 1, spread).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("spread", spread)
    first = F.col("step") - F.when(F.col("spread") > 1, F.col("spread") - 1).otherwise(0)
    placed = ranked.withColumn("first", first).withColumn("next", F.lead("first").over(own)).withColumn("next_spread", F.lead("spread").over(own)).select("source", "hour", "first", "spread", "next", "next_spread")
    rows = stated.withColumn("hour", hour).join(placed, ["source", "hour"]).withColumn("sub", F.pmod(F.xxhash64("job_id"), "spread").cast("int"))
    led = (F.col("next") > F.col("first") + F.col("spread") - 1) & (F.col("sub") == F.col("spread") - 1)
    follow = F.when(led, F.transform(F.sequence(F.lit(0), F.col("next_spread") - 1), lambda i: F.struct((F.col("next") + i).alias("part"), F.lit(True).alias("lead"))))
    parts = F.concat(F.array(F.struct((F.col("first") + F.col("sub")).alias("part"), F.lit(False).alias("lead"))), F.coalesce(follow, F.array().cast("array<struct<part:bigint,lead:boolean>>")))
    return rows.select(*stated.columns, F.explode(parts).alias("p")).select(*stated.columns, "p.part", "p.lead")


def monthly_pay(jobs: DataFrame, units: DataFrame, source: str = "vendor_id", time: str = "source_modified_at") -> DataFrame:
    """``job_id, min_twd_month, max_twd_month`` of every posting that states an amount."""
    factor = unit_factors(units)
    to_month = [factor["period", p] * factor["currency", c] * factor["scale", s] for p, c, s in STATES]
    logs = np.array([math.log(f) for f in to_month])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, low, high, named = [], [], [], []
            for i, r in enumerate(zip(*[b.column(c).to_pylist() for c in ("salary_text", "salary_min", "salary_max")], strict=True)):
                o = observation(*r)
                if o and (o["low"] or o["high"]):
                    at.append(i)
                    low.append(str(o["low"]))
                    high.append(str(o["high"]))
                    named.append([o["period"], o["currency"], o["scale"]])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("job_id").take(rows), b.column("source").take(rows), b.column("time").take(rows), pa.array(low, pa.string()), pa.array(high, pa.string()), pa.array(named, pa.list_(pa.string()))], names=["job_id", "source", "time", "low", "high", "named"])

    stated = jobs.select("job_id", F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(time).cast("string").alias("time"), "salary_text", "salary_min", "salary_max")
    stated = stated.mapInArrow(read, "job_id string, source string, time string, low string, high string, named array<string>")
    parts = sequences(materialize(stated))  # read for the counts and for the rows

    open_states: dict[tuple, np.ndarray] = {}

    def agreeing(named: list[str | None]) -> np.ndarray:
        """The states that agree with the parts of the unit a text names."""
        key = tuple(named)
        if key not in open_states:
            open_states[key] = np.array([all(n is None or n == v for n, v in zip(key, state, strict=True)) for state in STATES])
        return open_states[key]

    def decode(rows: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
        """One sequence of ``job_id, low, high, named, lead`` in order of time."""
        low, high = [Fraction(r[1]) for r in rows], [Fraction(r[2]) for r in rows]
        size = np.array([math.log((a + b) / (2 if a and b else 1)) for a, b in zip(low, high, strict=True)])
        states = viterbi(size[:, None] + logs[None, :], np.stack([agreeing(r[3]) for r in rows]))
        for r, a, b, state in zip(rows, low, high, states.tolist(), strict=True):
            if not r[4]:
                yield r[0], half_up(a * to_month[state]), half_up(b * to_month[state]), "/".join(STATES[state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def made(sequences_: list[list[tuple]]) -> pa.RecordBatch:
            cols = list(zip(*[o for rows in sequences_ for o in decode(rows)], strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["job_id", "min_twd_month", "max_twd_month", "unit"])

        for b in batches:
            done = []
            for source, part, *row in zip(*[b.column(c).to_pylist() for c in ("source", "part", "job_id", "low", "high", "named", "lead")], strict=True):
                if (source, part) != key:
                    if held:
                        done.append(held)
                    key, held = (source, part), []
                held.append(row)
            yield made(done)
        if held:
            yield made([held])

    ordered = parts.repartition("source", "part").sortWithinPartitions("source", "part", "time", "job_id")  # a task reads its sequences one after the other
    return ordered.mapInArrow(run, "job_id string, min_twd_month bigint, max_twd_month bigint, unit string")
