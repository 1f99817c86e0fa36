"""Texts cut off by field limits or in mid-transfer (problem 8).

* *Lengths*: for each source and unit (characters, UTF-8 bytes) the discrete hazard of a length L is the share
  of texts that end at L among those that reach it, computed with window functions over the table of lengths. It is tested
  against the hazard of the neighbouring lengths (Poisson tail); the Benjamini-Hochberg rule keeps the false-discovery
  rate of each source and unit at ``FDR``. What stays are the lengths at which a source cuts.
* *Endings*: a text that ends without a closing sign is compared with the whole corpus. For the last 10, 5, 3 and 2 signs of its
  last sentence (digits alike, cut at the sentence's start) the corpus gives how often that run goes on and how often a
  sentence ends with it, with and without a closing sign; the longest run with evidence counts. A text that is sent again counts once, and
  its own end is no evidence against itself. Runs are counted for the endings that occur, selected by a bit map of fixed size, pre-aggregated in each task.
* At a significant length of its source a text with an incomplete ending is cut: broken markup or sign, an opening or connecting sign, an ending that goes
  on elsewhere (``LIKELY``) or is unknown. Elsewhere (cuts in mid-transfer leave no length behind) the ending alone has to show it: broken, or going on
  mostly (``SURE``) or, with missing closing signs, nearly always (``ALWAYS``); before signs that stand for missing text ``LIKELY`` is enough.

Defined results: null, empty and blank texts are never cut; complete texts without a closing sign (list entries, contact
lines, tags) aren't either; a null source is a source of its own; repeated rows are judged alike; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodeline.runtime import materialize

RUNS = (10, 5, 3, 2)
FDR, NEAR, GAP, SURE, ALWAYS, LIKELY, EVIDENCE = 0.001, 25, 3, 0.6, 0.95, 0.25, 3
#: Bits of the map of asked runs: sixteen for each run, within these bounds. A fuller map only lets more runs through to the exact join.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
_MARK = re.compile(r"(?:…|\.{3})+$")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CONTROL = re.compile(r"<\|[^|<>]{1,30}\|>|</?s>")
_BROKEN_ENTITY = re.compile(r"&#?[A-Za-z0-9]{0,8}$")
#: Within these many signs an opened bracket that isn't closed is broken markup; further on only what reads as a tag with attributes to its end, of any length.
NEAR_BRACKET = 201
_OPEN_TAG = re.compile(r"""<[/!]?[A-Za-z][\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*\s*(?:[\w:@.-]+\s*=\s*(?:"[^"]*|'[^']*)?)?/?$""")
_END = re.compile(r"(?:[。！？!?；\n]|\.(?=[　-鿿（【]|\s+[^\s\d]|\s*$)|(?<=[a-z0-9])\.(?=[A-Z])|…|\.{3})[\s\-*●•。！？!?；…]*")
_SIGNED = re.compile(r"[。！？!?；]|^\.(?!\.\.)")
CLOSING = set("。！？!?.）)」』”\"’】〕]》>")
CONNECTING = set("，,、：:（(「『“【〔[《<&/+=\\")
_P1 = np.uint64(0x9E3779B97F4A7C15)
_P1_INVERSE = np.uint64(pow(int(_P1), -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def skeleton(text: str) -> str:
    """Sentence ends become one sign, 3 if they have a closing sign and 1 if not (line ends); starts with an end."""
    return "\x01" + _END.sub(lambda m: "\x03" if _SIGNED.search(m.group()) else "\x01", _CONTROL.sub("", text) if "<" in text else text)


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """The powers of an odd number modulo 2^64, kept for the next call."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 18), base, np.uint64)
        got[0] = 1
        _powers[int(base)] = got = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def run_keys(signs: np.ndarray) -> dict[int, np.ndarray]:
    """For every position the keys of the runs of k signs that end there, cut at the sentence's start (signs below 4).

    A polynomial hash: differences of running sums over the whole array, so that all lengths cost one pass.
    """
    n = len(signs)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(signs < 4, at, -1))  # the last sentence end up to here
    # the end itself belongs to the run, whatever its kind, so that a run that starts a sentence differs from the same signs within one
    value = _mix(np.where(signs < 4, np.uint64(1), signs) * _P1 + np.uint64(7))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _power(_P1, n), dtype=np.uint64)])
    back = _power(_P1_INVERSE, n)
    out = {}
    for k in RUNS:
        first = np.maximum(at - k + 1, np.maximum(start, 0))
        out[k] = _mix((total[at + 1] - total[first]) * back * np.uint64(2 * k + 1)).view(np.int64)
    return out


def codes(text: str) -> np.ndarray:
    """Code points, digits alike."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.where(((c >= 0x30) & (c < 0x3A)) | ((c >= 0xFF10) & (c < 0xFF1A)), np.uint64(0x39), c)


def without_trail(text: str) -> str:
    """Without blanks, blank entities and whole tags at the end."""
    while True:
        t = text.rstrip()
        if t.endswith(("&nbsp;", "&#160;")):
            t = t[:-6]
        elif t.endswith(">") and (i := t.rfind("<")) >= 0 and _TAG.fullmatch(t, i):
            t = t[:i]
        if t == text:
            return t
        text = t


def broken(text: str) -> bool:
    """Whether a text ends within a tag (of any length), an entity or a sign."""
    if text[-1] == "\ufffd" or _BROKEN_ENTITY.search(text, len(text) - 10 if len(text) > 10 else 0):
        return True
    i = text.rfind("<")
    return i >= 0 and text.find(">", i) < 0 and (len(text) - i <= NEAR_BRACKET or _OPEN_TAG.match(text, i) is not None)


def last_sentence(text: str) -> str:
    """The skeleton of the last sentence, read backwards in growing windows until it holds the sentence's start."""
    width = 128
    while True:
        s = skeleton(text[-width:]).replace("\x03", "\x01").rstrip("\x01")
        at = s.rfind("\x01")
        if at > 8 or width >= len(text):
            return s[at:] if s else ""
        width *= 4


def ending(text: str | None) -> tuple[str, str]:
    """``(state, tail)``: whole, cut, or ask with the last sentence's skeleton (mark, if signs for missing text follow it)."""
    if text is None or not text.strip():
        return "whole", ""
    t = without_trail(_CONTROL.sub("", text) if "<" in text else text)
    if not t:
        return "whole", ""
    if broken(t):
        return "cut", ""
    marked = _MARK.sub("", t) if t[-1] in ".…" else t
    if len(marked) == len(t):
        if t[-1] in CLOSING:
            return "whole", ""
        if t[-1] in CONNECTING:
            return "cut", ""
    elif not marked or marked[-1] in "。！？!?":
        return "whole", ""
    return "ask" if len(marked) == len(t) else "mark", last_sentence(marked)


def endings(docs: DataFrame) -> DataFrame:
    """``doc_id, source, digest, n_chars, n_bytes, state, keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            chars, size, states, tails = [], [], [], []
            for t in texts:
                state, tail = ending(t)
                own = (t or "").rstrip("\ufffd")
                chars.append(len(own))
                size.append(len(own.encode("utf-8", "surrogatepass")))
                states.append(state)
                tails.append(tail[-max(RUNS) - 1 :])
            joined = codes("".join(tails))
            made, at = run_keys(joined), 0
            keys = []
            for tail in tails:
                at += len(tail)
                keys.append([int(made[k][at - 1]) for k in RUNS] if tail else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("digest"), pa.array(chars, pa.int64()), pa.array(size, pa.int64()), pa.array(states), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "source", "digest", "n_chars", "n_bytes", "state", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), "source", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id bigint, source string, digest bigint, n_chars bigint, n_bytes bigint, state string, keys array<bigint>")


def map_bits(n: int) -> int:
    """The size of a bit map for n keys: a power of two, about sixteen bits a key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(n, 1)))))


def words(keys: DataFrame, bits: int) -> DataFrame:
    """``w, b``: the keys as a map of ``bits`` bits, at most bits / 32 rows."""
    spot = F.pmod(F.col("key"), F.lit(bits))
    return keys.select((spot / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) % 32 as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """The keys as a map of bits (eight to a byte), whatever their number."""
    out = np.zeros(bits // 32, np.uint32)
    got = words(keys, bits).toPandas()
    out[got.w.to_numpy(np.int64)] = got.b.to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def distinct_texts(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """``text``, each once. Only texts whose digest may occur again, by a bit map, are shuffled; the others stay in their scan."""
    repeated = materialize(ends.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("key")))
    bits = map_bits(repeated.count())
    again = F.broadcast(words(repeated, bits))  # bits / 32 rows
    texts = docs.select("text", F.xxhash64("text").alias("digest")).withColumn("spot", F.pmod(F.col("digest"), F.lit(bits)))
    marked = ((F.col("spot") / 32).cast("int") == F.col("w")) & F.expr("shiftright(b, cast(spot % 32 as int)) & 1L = 1L")
    once = texts.join(again, marked, "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(again, marked, "left_anti").select("text").unionByName(once.select("text"))


def continuations(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, goes_on, signed, ends``: how often each run of the asked endings goes on in the texts, or ends a sentence with or without a closing sign.

    asked: distinct ``key``. A bit map of them, sized by their number, selects positions within the tasks; what it lets through besides is dropped by the
    caller's join on the keys themselves.
    """
    bits = map_bits(asked.count())
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(asked, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = np.unpackbits(wanted.value, bitorder="little").astype(bool)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                # texts apart by sign 2; the last sentence of a text that ends openly isn't evidence for an end
                joined = codes("\x02".join(skeleton(t) for t in b.column("text").slice(at, 500).to_pylist() if t) + "\x02")
                following = np.concatenate([joined[1:], np.array([2], np.uint64)])
                counts = (joined > 3) & (following != 2)
                for key in run_keys(joined).values():
                    pick = np.flatnonzero(spots[key & (bits - 1)] & counts)
                    u, inverse = np.unique(key[pick], return_inverse=True)
                    after = following[pick]
                    signed, end = (np.bincount(inverse, weights=after == sign, minlength=len(u)).astype(np.int64) for sign in (3, 1))
                    all_ = np.bincount(inverse, minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(all_ - signed - end), pa.array(signed), pa.array(end)], names=["key", "goes_on", "signed", "ends"])

    counts = docs.select("text").mapInArrow(run, "key bigint, goes_on bigint, signed bigint, ends bigint")
    return counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("goes_on", "signed", "ends")])


@F.pandas_udf(DoubleType())
def poisson_tail(n: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X >= n) of a Poisson law."""

    def tail(k: int, m: float) -> float:
        if m <= 0:
            return 0.0 if k > 0 else 1.0
        if k <= m:
            return 1.0
        term, total, i = math.exp(k * math.log(m) - m - math.lgamma(k + 1)), 0.0, k
        while term > 1e-300 and i < k + 10_000:
            total += term
            i += 1
            term *= m / i
            if term < total * 1e-12:
                break
        return min(1.0, total)

    return pd.Series([tail(int(k), float(m)) for k, m in zip(n, mean, strict=True)])


def cutting_lengths(ends: DataFrame) -> DataFrame:
    """``source, unit, length, n, expected, p``: lengths whose hazard stands out, by the Benjamini-Hochberg rule.

    A text that a source sends again counts once.
    """
    lengths = ends.filter("n_chars > 0").select("source", "digest", "n_chars", "n_bytes").distinct().select("source", F.explode(F.create_map(F.lit("chars"), "n_chars", F.lit("bytes"), "n_bytes")).alias("unit", "length"))
    counts = lengths.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    own = Window.partitionBy("source", "unit").orderBy("length")
    risk = counts.withColumn("risk", F.sum("n").over(own.rowsBetween(0, Window.unboundedFollowing)))

    def neighbours(width: int) -> tuple[Column, Column]:
        """Texts that end within width of a length, and the sum of those that reach each length there, whether or not any ends at it."""
        within = own.rangeBetween(-width, width)
        low, n = F.greatest(F.col("length") - width, F.lit(1)), F.sum("n").over(within)
        beyond = F.coalesce(F.sum("n").over(own.rangeBetween(width + 1, Window.unboundedFollowing)), F.lit(0))
        return n, F.sum(F.col("n") * F.col("length")).over(within) - n * (low - 1) + beyond * (F.col("length") + width - low + 1)

    (n_around, risk_around), (n_near, risk_near) = neighbours(NEAR), neighbours(GAP)
    tested = risk.withColumn("m", n_around - n_near).withColumn("reach", risk_around - risk_near)
    # the neighbours' pooled hazard; half a text is added so that empty surroundings don't make everything stand out
    tested = tested.withColumn("expected", F.col("risk") * (F.col("m") + 0.5) / F.greatest("reach", F.lit(1)))
    tested = tested.withColumn("p", poisson_tail("n", "expected"))
    order = Window.partitionBy("source", "unit").orderBy("p")
    m = tested.groupBy(F.col("source").alias("s"), F.col("unit").alias("u")).agg(F.count("*").alias("tests"))
    ranked = tested.withColumn("r", F.rank().over(order)).join(m, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")))
    bound = ranked.filter(F.col("p") <= FDR * F.col("r") / F.col("tests"))
    return bound.select("source", "unit", "length", "n", F.round("expected", 6).alias("expected"), "p")


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, source, cut, at_limit, by`` for every row. ``by``: what decides, a significant length with an incomplete ending, or elsewhere a broken end or the ending
    alone."""
    ends = materialize(endings(docs).withColumn("row", F.monotonically_increasing_id()))
    limits = cutting_lengths(ends).select(F.col("source").alias("s"), "unit", "length")
    by = ends.select("row", "source", F.explode(F.create_map(F.lit("chars"), "n_chars", F.lit("bytes"), "n_bytes")).alias("unit", "length"))
    at = by.join(limits.withColumnRenamed("unit", "u").withColumnRenamed("length", "l"), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")) & (F.col("length") == F.col("l"))).select("row").distinct().withColumn("at_limit", F.lit(True))
    own = ends.filter("state in ('ask', 'mark') and size(keys) > 0").groupBy("digest").agg(F.first("keys").alias("keys"))
    asked = own.select("digest", F.posexplode("keys").alias("level", "key"))
    tails = materialize(asked.groupBy("key").agg(F.count("*").alias("tails")))
    known = tails.join(continuations(distinct_texts(docs, ends), tails.select("key")), "key", "left").select("key", "tails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("goes_on", "signed", "ends")])
    known = known.withColumn("total", F.col("goes_on") + F.col("signed") + F.col("ends") + F.col("tails") - 1).filter(F.col("total") >= EVIDENCE)
    open_ = asked.join(known, "key").groupBy("digest").agg(F.min_by(F.struct((F.col("goes_on") / F.col("total")).alias("open"), ((F.col("goes_on") + F.col("signed")) / F.col("total")).alias("unsigned")), "level").alias("e")).select("digest", "e.open", "e.unsigned")
    out = ends.join(open_, "digest", "left").join(at, "row", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    open_share, unsigned = F.coalesce("open", F.lit(0.0)), F.coalesce("unsigned", F.lit(0.0))
    unknown = F.col("open").isNull()  # an ending that occurs nowhere else
    asked_ = (open_share >= SURE) | (unsigned >= ALWAYS)
    marked = open_share >= LIKELY
    # at a significant length an incomplete ending is enough; elsewhere the ending alone has to show it
    at_length = F.col("at_limit") & ((F.col("state") == "cut") | ((F.col("state") == "ask") & (asked_ | (unsigned >= LIKELY) | unknown)) | ((F.col("state") == "mark") & (marked | unknown)))
    alone = ((F.col("state") == "ask") & asked_) | ((F.col("state") == "mark") & marked)
    by = F.when(at_length, "length").when(F.col("state") == "cut", "broken end").when(alone, "ending")
    return out.select("doc_id", "source", by.isNotNull().alias("cut"), "at_limit", by.alias("by"), F.round("open", 4).alias("open"), F.round("unsigned", 4).alias("unsigned"), "state")


def found(docs: DataFrame) -> DataFrame:
    return judged(docs).filter("cut").select("doc_id").distinct()


def report(docs: DataFrame) -> DataFrame:
    """``source, documents, cut_documents, share`` and its parts: how often each source cuts, at its significant lengths and elsewhere in mid-transfer
    (where markup, an entity or a sign is broken, or where the ending alone shows it)."""
    cut = F.col("cut")
    return judged(docs).groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(cut).alias("cut_documents"),
        F.round(F.count_if(cut) / F.count("*"), 6).alias("share"),
        F.count_if(F.col("by") == "length").alias("at_limit"),
        F.count_if(F.col("by") == "broken end").alias("broken_end"),
        F.count_if(F.col("by") == "ending").alias("mid_text"),
    )
