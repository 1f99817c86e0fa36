"""Several values packed in one field (problem 4): infer the delimiters of each source, split, explode with position.

*Inference*: for every source (a field of what one vendor delivers) each candidate sign is scored over all rows by two shares:

* *piece type regularity*: an occurrence outside quotes and brackets has two sides; a side is regular if its piece is of a known type (a known
  name, a quoted or a bracketed value);
* *piece-count consistency*: the names and quoted values seen anywhere in a row, found without cutting it, say how many pieces to expect. A row is
  consistent with a sign if cutting at it brings the number of pieces closer to that number than not cutting at it, or leaves it as close.

``score = regular share * consistent share``, both drawn to the field's share over all sources by ``WEIGHT`` observations, so that a source with few rows
follows its field. Signs that reach ``ACCEPT`` for a source separate there. ``WEAK`` signs (blanks, bare slashes, signs of spelling) also stand inside names;
they are scored inside the pieces of the others, where they stand outside known names and next to one, and where they are accepted they separate names only.

*Splitting*: text in quotes is one value, round brackets keep what they hold together, a known name is one value; list signs
and numbers before a value, outer blanks and quotes are dropped. Defined results: null, empty and fields that say there is
nothing (``EMPTY``) give no rows; empty places don't count; repeated values and repeated rows do; an unclosed quote is
an ordinary sign; values of any length are kept whole; rows without a source are a source of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import materialize

#: Ways to say that there is nothing.
EMPTY = {"", "null", "none", "n/a", "na", "nil", "無", "無需求", "不拘", "-", "--", "—", "不需", "無要求"}
QUOTES = {'"': '"', "“": "”", "「": "」", "『": "』", "'": "'", "‘": "’", "＂": "＂", "《": "》"}
OPEN, CLOSE = "(（", ")）"
BLANK = " 　\xa0"
CANDIDATES = ["、", "，", ",", "；", ";", "|", "｜", "／", " / ", "\t", "\n"]
WEAK = ["/", " ", "　", ":", "&", "+", "-", "."]
_WEAK_SIGN = re.compile("[" + "".join(map(re.escape, WEAK)) + "]")
ACCEPT, WEIGHT = 0.5, 20
#: Salts of the join of rows with their source's signs; one source may hold a third of all rows.
SALTS = 16
APART = "\x00"
_NUMBER = re.compile(r"(?:[(（]\d{1,2}[)）]|\d{1,2}(?:[、)）]|\.(?!\d)))\s*")
_SIGN = re.compile(r"(?:[•●○◆■▪‧·*]|-(?=\s))\s*")
_INLINE = re.compile(r"\s+(?=(?:[(（]\d{1,2}[)）]|\d{1,2}[、)）]|\d{1,2}\.(?!\d))\s*\S|[•●○◆■▪]|[*\-]\s)")

_LISTED = re.compile(r"\s[\d(（•●○◆■▪*\-]")
_PROTECTING = re.compile(rf"[{re.escape(''.join(QUOTES) + OPEN)}\d]")


def says_nothing(text: str | None) -> bool:
    return text is None or text.strip().lower() in EMPTY


def unwrap(text: str) -> str:
    """Drop the brackets around a whole list."""
    t = text.strip()
    if len(t) > 1 and t[0] + t[-1] in ("[]", "{}", "【】"):
        return t[1:-1]
    return text


def protected(text: str) -> list[tuple[int, int]]:
    """Spans of quoted and bracketed text. A quote opens only where a value may start."""
    if not _PROTECTING.search(text):
        return []
    spans, i, n = [], 0, len(text)
    starts = True
    while i < n:
        ch = text[i]
        if starts and ch in QUOTES:
            end = text.find(QUOTES[ch], i + 1)
            if end > 0:
                spans.append((i, end + 1))
                i, starts = end + 1, False
                continue
        if starts and (m := _NUMBER.match(text, i)):
            spans.append((i, m.end()))
            i = m.end()
            continue
        if ch in OPEN:
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (text[j] in OPEN) - (text[j] in CLOSE)
                j += 1
            if not depth:
                spans.append((i, j))
                i, starts = j, False
                continue
        starts = ch.isspace() or ch in "、，,；;|｜／/[{•●○◆■▪*" or (ch == "-" and starts)
        i += 1
    return spans


@lru_cache(maxsize=4_096)
def _any_of(signs: tuple[str, ...]) -> re.Pattern:
    """The signs as one pattern, the longest first at one place."""
    return re.compile("|".join(re.escape(s) for s in sorted(signs, key=len, reverse=True)) or r"(?!)")


def _cuts(text: str, signs: Sequence[str]) -> list[tuple[int, int, str]]:
    """Occurrences ``(start, end, sign)`` of the signs outside protected text; a blank before a list sign or number counts as the sign ``list``."""
    spans, found = protected(text), []
    find = _any_of(tuple(signs)).finditer
    for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(text)], strict=True):
        found += [(m.start(), m.end(), m.group()) for m in find(text, a, b)]
    inline = [m.span() for m in _INLINE.finditer(text)] if _LISTED.search(text) else []
    if not inline:
        return found
    outside = [(a, b, "") for a, b in inline if not any(s <= a < e for s, e in spans)]  # "" sorts first at one place
    out, at = [], 0
    for a, b, sign in sorted(found + outside, key=lambda c: (c[0], c[2])):
        if a >= at:
            out.append((a, b, sign or "list"))
            at = b
    return out


def clean(piece: str) -> tuple[str, bool]:
    """The value without list signs, numbers, outer blanks and quotes; whether it was quoted."""
    p = piece.strip()
    while m := _SIGN.match(p) or _NUMBER.match(p):
        if m.end() == len(p):
            break
        p = p[m.end() :].strip()
    quoted = False
    while len(p) > 1 and p[0] in QUOTES and p[-1] == QUOTES[p[0]] and QUOTES[p[0]] not in p[1:-1]:
        p, quoted = p[1:-1].strip(), True
    return ("" if p in ("-", "*", "•", "●") else p), quoted


def _names_only(piece: str, names: set[str], weak: Sequence[str]) -> list[str]:
    """Cut at weak signs if every part is a known name, in as few parts as possible; else the piece itself."""
    if not any(sign in piece for sign in weak):
        return [piece]
    tokens = re.split(f"([{''.join(map(re.escape, weak))}]+)", piece)
    n = len(tokens)
    best: list[list[str] | None] = [None] * (n + 2)
    best[0] = []
    for end in range(1, n + 1, 2):
        for start in range(0, end, 2):
            word = "".join(tokens[start:end]).strip()
            if best[start] is not None and word in names and (best[end + 1] is None or len(best[start]) + 1 < len(best[end + 1])):
                best[end + 1] = [*best[start], word]
    return best[n + 1] or [piece]


def split(text: str | None, names: set[str], strong: Sequence[str], weak: Sequence[str]) -> list[str]:
    """The values of one field in the order written."""
    if says_nothing(text):
        return []
    t = unwrap(text)
    if (whole := t.strip()) in names:
        return [whole]
    out, at = [], 0
    for start, end, _ in [*_cuts(t, strong), (len(t), len(t), "")]:
        value, quoted = clean(t[at:start])
        at = end
        if value and not (value.lower() in EMPTY and not quoted):
            out += [value] if quoted or value in names or protected(value)[:1] == [(0, len(value))] else _names_only(value, names, weak)
    return out


def _regular(piece: str, names: set[str]) -> bool:
    value, quoted = clean(piece)
    return quoted or value in names or (len(value) > 2 and value[-1] in CLOSE)


class Names:
    """Known names, found anywhere in a text by their first sign, the longest first."""

    def __init__(self, names: set[str]) -> None:
        self.names = names
        self.by_sign: dict[str, list[str]] = {}
        for n in sorted(names, key=len, reverse=True):
            if n:
                self.by_sign.setdefault(n[0], []).append(n)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where names and quoted values stand in a text; brackets keep what they hold together."""
        found, i, k, kept = [], 0, 0, protected(text)
        while i < len(text):
            while k < len(kept) and kept[k][1] <= i:
                k += 1
            if k < len(kept) and kept[k][0] == i:
                if text[i] in QUOTES:
                    found.append(kept[k])
                i = kept[k][1]
                continue
            for n in self.by_sign.get(text[i], ()):
                if text.startswith(n, i) and not (i and _joined(text[i - 1], n[0])) and not (i + len(n) < len(text) and _joined(n[-1], text[i + len(n)])):
                    found.append((i, i + len(n)))
                    i += len(n)
                    break
            else:
                i += 1
        return found


def _joined(a: str, b: str) -> bool:
    """Latin letters and digits side by side belong to one word."""
    return a.isascii() and b.isascii() and a.isalnum() and b.isalnum()


def evidence(text: str, names: Names) -> dict[str, tuple[int, int, int, int]]:
    """For each candidate in a text: ``(occurrences, regular ones, rows, consistent rows)``."""
    t = unwrap(text)
    cuts = _cuts(t, CANDIDATES)
    edges = [0, *[x for c in cuts for x in c[:2]], len(t)]
    pieces = [t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
    regular = [_regular(p, names.names) for p in pieces]
    filled = [bool(p.strip()) for p in pieces]
    out: dict[str, list[int]] = {}
    for i, (_, _, sign) in enumerate(cuts):
        if sign != "list":
            e = out.setdefault(sign, [0, 0, 1, 0])
            last = i == len(cuts) - 1 and not filled[i + 1]
            e[0] += 2 - last
            e[1] += regular[i] + (regular[i + 1] and not last)
    weak = [clean(p)[0] if not ok and _WEAK_SIGN.search(p) else "" for p, ok in zip(pieces, regular, strict=True)]
    if out:
        # values seen without regard to the cuts: a piece of a known type is one, in others the names count
        expected, all_ = sum(1 if ok else len(names.spans(p)) if filled_ else 0 for p, ok, filled_ in zip(pieces, regular, filled, strict=True)), sum(filled)
        for sign, e in out.items():
            lost = sum(a and b for a, b, c in zip(filled, filled[1:], cuts, strict=False) if c[2] == sign)  # places where two pieces would be one
            e[3] = int(abs(all_ - expected) <= abs(all_ - lost - expected))
    for value in filter(None, weak):
        inside = names.spans(value)
        for sign in {m.group() for m in _WEAK_SIGN.finditer(value)} if inside else ():
            at = [m.start() for m in re.finditer(re.escape(sign), value) if not any(a <= m.start() < b for a, b in inside)]
            parts = [value[a:b].strip() for a, b in zip([0, *[i + len(sign) for i in at]], [*at, len(value)], strict=True)]
            named = sum(x in names.names for x in parts)
            if at and named:  # a value of several words says nothing about what separates names
                e = out.setdefault(sign, [0, 0, 0, 0])
                e[0] += len(parts)
                e[1] += named
                e[2] += 1
                e[3] += abs(sum(map(bool, parts)) - len(inside)) <= abs(1 - len(inside))
    return {k: tuple(v) for k, v in out.items()}


KEEP = 50_000  # different texts of which a task keeps what it made, against repeated work


def counted(values: DataFrame, names: set[str]) -> DataFrame:
    """``field, source, sign, occurrences, regular, rows, consistent`` from ``field, source, text`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, made = Names(names), {}
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for field, source, text in zip(*[b.column(c).to_pylist() for c in ("field", "source", "text")], strict=True):
                if says_nothing(text):
                    continue
                own = made.get(text)
                if own is None:
                    own = evidence(text, known)
                    if len(made) < KEEP:
                        made[text] = own
                for sign, e in own.items():
                    t = total.setdefault((field, source, sign), [0, 0, 0, 0])
                    for i in range(4):
                        t[i] += e[i]
            rows = [(*k, *v) for k, v in total.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 3 else pa.int64()) for i, c in enumerate(cols)], names=["field", "source", "sign", *COUNTS])

    got = values.select("field", "source", "text").mapInArrow(run, "field string, source string, sign string, occurrences bigint, regular bigint, rows bigint, consistent bigint")
    return got.groupBy("field", "source", "sign").agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ("occurrences", "regular", "rows", "consistent")


def inferred(values: DataFrame, names: set[str]) -> DataFrame:
    """``field, source, sign``, the counts, ``score`` and ``accepted``, for every sign that a source holds."""
    own = materialize(counted(values, names))
    fields = own.groupBy("field", "sign").agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS])
    drawn = lambda part, whole: (F.col(part) + WEIGHT * F.col(f"all_{part}") / F.col(f"all_{whole}")) / (F.col(whole) + WEIGHT)
    scored = own.join(F.broadcast(fields), ["field", "sign"])  # fields times candidate signs
    score = F.round(drawn("regular", "occurrences") * drawn("consistent", "rows"), 4)
    return scored.select("field", "source", "sign", *COUNTS, score.alias("score")).withColumn("accepted", F.col("score") >= ACCEPT)


def fields_long(rows: DataFrame, fields: Sequence[str], *kept: str) -> DataFrame:
    """One row for each field: the kept columns, ``field, text``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    return rows.select(*kept, F.explode(pairs).alias("f")).select(*kept, "f.field", "f.text")


def with_source(raw: DataFrame, origin: DataFrame, on: str, source: str) -> DataFrame:
    """The rows with ``source``, looked up by the key ``on`` in ``origin`` (one row a key); an unknown one is ``""``."""
    of = origin.select(F.col(on).alias("_key"), F.col(source).alias("_source")).filter("_key is not null").groupBy("_key").agg(F.min("_source").alias("_source"))
    return raw.join(of, F.col(f"`{on}`") == F.col("_key"), "left").withColumn("source", F.coalesce("_source", F.lit(""))).drop("_key", "_source")


def split_fields(raw: DataFrame, fields: Sequence[str], names: set[str], key: str = "source_row") -> DataFrame:
    """``key, field_name, pos, val``: one row for each value of each field of each row. raw: ``key``, the fields and ``source`` (of the row; may be absent)."""
    rows = raw if "source" in raw.columns else raw.withColumn("source", F.lit(""))
    rows = materialize(rows.select(key, *[F.col(f"`{f}`") for f in fields], F.coalesce("source", F.lit("")).alias("source")))  # read for inference and for splitting
    accepted = inferred(fields_long(rows, fields, "source"), names).filter("accepted").groupBy("source", "field").agg(F.array_join(F.array_sort(F.collect_list("sign")), APART).alias("signs"))
    signs = accepted.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("field", "signs"))).alias("signs"))
    salted = signs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    long = fields_long(rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"], "left"), fields, key, "signs")
    long = long.select(key, "field", "text", F.coalesce(F.element_at("signs", F.col("field")), F.lit("")).alias("signs"))
    kind = raw.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str]] = {}
        for b in batches:
            sources, at, pos, vals = [], [], [], []
            for i, (field, text, own) in enumerate(zip(*[b.column(c).to_pylist() for c in ("field", "text", "signs")], strict=True)):
                got = known.get((text, own))
                if got is None:
                    signs_ = [x for x in own.split(APART) if x]
                    got = split(text, names, [x for x in signs_ if x not in WEAK], [x for x in signs_ if x in WEAK])
                    if len(known) < KEEP:
                        known[text, own] = got
                for p, v in enumerate(got, 1):
                    at.append(i)
                    sources.append(field)
                    pos.append(p)
                    vals.append(v)
            keys = b.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sources, pa.string()), pa.array(pos, pa.int32()), pa.array(vals, pa.string())], names=[key, "field_name", "pos", "val"])

    return long.mapInArrow(run, f"`{key}` {kind}, field_name string, pos int, val string")
