"""Text that looks the same in different characters (problem 3).

* *Vocabulary*: the plainly written words of all texts with their counts (and Han signs that have other codes). A word is a run of
  letters, digits, accents and signs without width; a Han sign is a word of its own. Words that hold a sign of other width, code,
  composition or script, or one without width, are variants.
* *Match*: vocabulary and distinct variants meet by the look of their first ``PREFIX`` signs. Each such group's vocabulary is a trie, and every
  variant walks it with a weighted edit automaton: replacing a look-alike and skipping an ignorable cost 0, a further reading of a sign
  (a Greek iota read as a small l) costs ``FURTHER``, any other edit costs more than ``BUDGET`` and isn't followed. States are trie nodes with the
  least cost that reaches them. The spelling of least cost is canonical; ties go to the more frequent one, then the smaller.
* *Table*: a variant without a match is normalised sign by sign, and so are punctuation and blanks. Where a variant has one reading only, its
  table form counts as a word of the vocabulary, so that other spellings of it find it.

Look-alikes of other scripts aren't listed here: they are derived from Unicode's confusables as ICU (part of Spark) holds them, see ``look_alikes``.

Defined results: null stays null; empty and blank texts give ``""``; runs of blanks of any kind become one blank, none at the ends; case, digits,
punctuation other than width and hyphen code, and characters of another shape are kept. Very long texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.runtime import materialize

PREFIX, FURTHER, BUDGET = 2, 0.25, 0.5
#: Spellings that are sent to all tasks as one map; beyond this number of words they are joined to the rows.
MAP_WORDS = 200_000

#: Signs without width besides Unicode's format characters, and hyphens besides "-" (fixed values).
ZERO_WIDTH_MARKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0}
HYPHENS = {0x2010, 0x2011, 0xFE63}
#: Decompositions that only change code, width or font of the same letter.
SAME_SIGN = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
#: Where signs with another plain sign lie.
VARIANT_BLOCKS = [(0x80, 0x3400), (0xA640, 0xABC0), (0xF900, 0x10000), (0x10280, 0x10600), (0x1D400, 0x1D800), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0)]


def ignorable(o: int) -> bool:
    return unicodedata.category(chr(o)) == "Cf" or o in ZERO_WIDTH_MARKS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Letters of scripts other than Latin with the ASCII letters they are drawn like, the nearest first.

    Two signs are drawn alike if Unicode's confusables give them one skeleton. Only letters with case take part (others, as Arabic or Han, aren't read as
    Latin). Of several ASCII letters with one skeleton (I and l) the one of the same case comes first.
    """
    letters = [chr(o) for a, b in VARIANT_BLOCKS for o in range(a, b) if unicodedata.category(chr(o)) in ("Lu", "Ll") and "LATIN" not in unicodedata.name(chr(o)) and unicodedata.normalize("NFKC", chr(o)) == chr(o)]
    ascii_ = [chr(o) for o in range(128) if chr(o).isalpha()]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = checker.getSkeleton("\n".join([*ascii_, *letters, "ɡ"])).split("\n")
    by: dict[str, list[str]] = {}
    for c, s in zip(ascii_, skeletons, strict=False):
        by.setdefault(s, []).append(c)
    found = {}
    for c, s in zip([*letters, "ɡ"], skeletons[len(ascii_) :], strict=True):
        if s in by:
            found[ord(c)] = "".join(sorted(by[s], key=lambda a: (a.isupper() != c.isupper(), a)))
    return found


class Signs(dict):
    """The table: code point -> plain text, by rule, for ``str.translate``; filled on first use. ``alike``: from ``look_alikes``."""

    def __init__(self, alike: dict[int, str]) -> None:
        self.alike = alike

    def __missing__(self, o: int) -> str:
        self[o] = out = self._plain(o)
        return out

    def _plain(self, o: int) -> str:
        ch = chr(o)
        if ignorable(o):
            return ""
        if o in self.alike:
            return self.alike[o][0]
        if o in HYPHENS:
            return "-"
        if ch.isspace():
            return " "
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            return ch
        tag = parts[0] if parts[0][0] == "<" else ""
        if tag and tag not in SAME_SIGN and not (tag == "<compat>" and unicodedata.category(ch)[0] in "LS" and unicodedata.normalize("NFKC", ch).isalpha()):
            return ch
        if not tag and len(parts) > 1:
            return ch  # a letter with its accent: NFC composes both ways of writing it
        return unicodedata.normalize("NFKC", ch)

    def readings(self, o: int) -> list[tuple[str, float]]:
        """What a sign may stand for, with the cost of each reading."""
        return [(a, FURTHER * (i > 0)) for i, a in enumerate(self.alike.get(o) or [self[o]])]

    def form(self, text: str) -> str:
        """Normalise by table alone."""
        t = text.translate(self)
        if not t.isascii():
            t = unicodedata.normalize("NFC", t)
            t = unicodedata.normalize("NFC", t.translate(self))
        return _BLANKS.sub(" ", t).strip(" ")


_BLANKS = re.compile(r" {2,}")
_PLAIN = re.compile(rf"[^\W\d_{HAN}][^\W_{HAN}]*")


def _set_of(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + (f"-{re.escape(chr(points[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


class Words:
    """Finds the words of texts. ``variant`` matches a sign that makes its word a variant."""

    def __init__(self, signs: Signs) -> None:
        self.signs = signs
        free, han, letters = [], [], []
        for a, b in VARIANT_BLOCKS:
            for o in range(a, b):
                plain = signs[o]
                if plain == "":
                    free.append(o)
                elif unicodedata.category(chr(o))[0] == "M":
                    letters.append(o)
                elif plain != chr(o) and plain.isalnum():
                    (han if re.match(f"[{HAN}]", plain) else letters).append(o)
        self.targets = frozenset("".join(signs[o] for o in han))
        self.variant = re.compile(f"[{_set_of(sorted(free + han + letters))}]")
        marks = _set_of([o for o in sorted(free + letters) if not chr(o).isalnum()])
        self.token = re.compile(f"[{_set_of(han)}]|(?:[^\\W_{HAN}]|[{marks}])+")

    def count(self, texts: list[str | None]) -> tuple[Counter, Counter]:
        """Plain words and variants of texts with the number of times they occur."""
        plain, variants = Counter(), Counter()
        for t in texts:
            if not t:
                continue
            if self.variant.search(t):
                for w in self.token.findall(t):
                    (variants if self.variant.search(w) else plain)[w] += 1
            else:
                plain.update(_PLAIN.findall(t))
            plain.update(self.targets.intersection(t))
        return plain, variants


class Trie:
    """A vocabulary with counts; ``spelling`` walks it with the automaton."""

    def __init__(self, signs: Signs) -> None:
        self.signs, self.root = signs, {}

    def add(self, word: str, count: int = 1) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = (-max(count, node.get("", (0, ""))[0] * -1), word)

    def spelling(self, variant: str) -> str | None:
        """The word of least cost within the budget, or None."""
        states: list[tuple[float, dict]] = [(0.0, self.root)]
        signs, i, n = variant if variant.isascii() else unicodedata.normalize("NFD", variant), 0, 0
        n = len(signs)
        while i < n and states:
            o = ord(signs[i])
            i += 1
            if ignorable(o):
                continue
            marks = ""  # accents of this sign; the trie holds composed letters
            while i < n and (unicodedata.combining(signs[i]) or ignorable(ord(signs[i]))):
                marks += self.signs[ord(signs[i])]
                i += 1
            reached: dict[int, tuple[float, dict]] = {}
            for reading, extra in self.signs.readings(o):
                for cost, node in states:
                    if cost + extra > BUDGET:
                        continue
                    for ch in unicodedata.normalize("NFC", reading + marks):
                        node = node.get(ch)
                        if node is None:
                            break
                    else:
                        if id(node) not in reached or cost + extra < reached[id(node)][0]:
                            reached[id(node)] = (cost + extra, node)
            states = list(reached.values())
        ends = [(cost, *node[""]) for cost, node in states if "" in node]
        return min(ends)[2] if ends else None


def word_table(df: DataFrame, columns: list[str], alike: dict[int, str]) -> DataFrame:
    """``word, variant, look, n``: the distinct words of all texts; counted in each batch, then by Spark. ``look``: how the first signs look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(alike)
        words = Words(signs)
        reading: dict[str, str] = {}
        for s in alike.values():  # letters that one sign may stand for look alike
            for c in s:
                reading[c] = min(s)
        look = str.maketrans(reading)
        one_form = {o for o, s in alike.items() if len(s) == 1}
        for b in batches:
            plain, variants = Counter(), Counter()
            for c in columns:
                p, v = words.count(b.column(c).to_pylist())
                plain.update(p)
                variants.update(v)
            rows = [(w, True, signs.form(w), n) for w, n in variants.items()]
            seen = {form: 0 for w, _, form, _ in rows if all(o not in alike or o in one_form for o in map(ord, w))}
            rows += [(w, False, w, n) for w, n in plain.items()]
            rows += [(w, False, w, n) for w, n in seen.items() if w not in plain]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2][:PREFIX].translate(look) for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=["word", "variant", "look", "n"]
            )

    found = df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, "word string, variant boolean, look string, n bigint")
    return found.groupBy("word", "variant", "look").agg(F.sum("n").alias("n"))


def spellings(df: DataFrame, columns: list[str], alike: dict[int, str]) -> DataFrame:
    """``word, canonical, n``: every variant with the vocabulary's spelling; null where no word of the vocabulary looks like it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs(alike)
        look, trie = None, Trie(signs)
        for b in batches:
            out: list[tuple[str, str | None, int]] = []
            for word, variant, own, n in zip(*[b.column(c).to_pylist() for c in ("word", "variant", "look", "n")], strict=True):
                if own != look:
                    look, trie = own, Trie(signs)
                if variant:
                    out.append((word, trie.spelling(word), n))
                else:
                    trie.add(word, n)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "canonical", "n"])

    words = word_table(df, columns, alike)
    # a look's vocabulary comes before its variants, so one trie at a time is held
    return words.repartition("look").sortWithinPartitions("look", "variant").mapInArrow(run, "word string, canonical string, n bigint")


def writer(signs: Signs, words: Words) -> Callable[[str | None, dict[str, str]], str | None]:
    """A function from a text and the spellings of its variants to its form."""

    def form(text: str | None, known: dict[str, str]) -> str | None:
        if text is None:
            return None
        if words.variant.search(text):
            text = words.token.sub(lambda m: known.get(m.group()) or m.group(), text)
        return signs.form(text)

    return form


def with_forms(df: DataFrame, columns: dict[str, str], map_words: int = MAP_WORDS) -> DataFrame:
    """Add for each ``source column -> new name`` the common form. The vocabulary is that of all texts of these columns.

    Up to ``map_words`` variants go to all tasks as one map and texts aren't shuffled; more are joined to the rows that hold them. Both give the same
    forms. Name clashes: a new name that exists already is replaced, all other columns stay as they are.
    """
    spark = df.sparkSession
    alike = look_alikes(spark)
    kept = [c for c in df.columns if c not in columns.values()]
    chosen = materialize(spellings(df, list(columns), alike).filter("canonical is not null").select("word", "canonical"))
    texts = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, *columns])])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema] + [f"`{n}` string" for n in columns.values()])

    def written(batches: Iterator[pa.RecordBatch], known: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
        signs = Signs(alike)
        form = writer(signs, Words(signs))
        for b in batches:
            maps = [known] * b.num_rows if known is not None else [dict(m or ()) for m in b.column("_spelled").to_pylist()]
            arrays = [b.column(c) for c in kept]
            arrays += [pa.array([form(t, m) for t, m in zip(b.column(c).to_pylist(), maps, strict=True)], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *columns.values()])

    few = chosen.limit(map_words + 1).toPandas()
    if len(few) <= map_words:
        sent = spark.sparkContext.broadcast(dict(zip(few.word, few.canonical, strict=True)))
        return texts.mapInArrow(lambda batches: written(batches, sent.value), schema)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Signs(alike))
        for b in batches:
            rows, found = [], []
            for at, of in zip(b.column("_row").to_pylist(), zip(*[b.column(c).to_pylist() for c in columns], strict=True), strict=True):
                own = set(words.count(list(of))[1])
                rows += [at] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], names=["_row", "word"])

    numbered = materialize(texts.withColumn("_row", F.monotonically_increasing_id()))
    own = numbered.mapInArrow(held, "_row bigint, word string").join(chosen, "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("_spelled"))
    return numbered.join(own, "_row", "left").drop("_row").mapInArrow(lambda batches: written(batches, None), schema)


def comparable(jobs: DataFrame, least: int = 40) -> DataFrame:
    """``job_id, title, description`` with ``title_form, description_form`` of the postings that take part:
    they have an id, and the form of the description has ``least`` characters or more besides blanks."""
    d = with_forms(jobs.select("job_id", "title", "description").filter(F.col("job_id").isNotNull()), {"title": "title_form", "description": "description_form"})
    return d.filter(F.length(F.regexp_replace(F.col("description_form"), " ", "")) >= least)


def looked(jobs: DataFrame, least: int = 40) -> DataFrame:
    """``job_id, look, spelling`` of the postings that take part: digests of the forms and of the characters."""
    return comparable(jobs, least).select(
        "job_id",
        F.sha2(F.concat_ws("\x01", F.coalesce("title_form", F.lit("")), "description_form"), 256).alias("look"),
        F.sha2(F.concat_ws("\x01", F.coalesce("title", F.lit("")), "description"), 256).alias("spelling"),
    )


def look_classes(jobs: DataFrame, least: int = 40) -> DataFrame:
    """The classes of ``look_pairs`` without expanding them: ``look, spelling, first_job_id, copies`` of every look that is written in more ways than one."""
    own = looked(jobs, least).groupBy("look", "spelling").agg(F.min("job_id").alias("first_job_id"), F.countDistinct("job_id").alias("copies"))
    mixed = own.groupBy("look").agg(F.count("*").alias("n")).filter("n > 1").select("look")
    return own.join(mixed, "look", "left_semi")


def look_pairs(jobs: DataFrame, least: int = 40) -> DataFrame:
    """Pairs of postings that look the same while their characters differ.

    Different spellings of a look are paired first, then each is replaced by its members: exact copies never meet each other, so the rows that are made are
    the rows that come out.
    """
    d = materialize(looked(jobs, least))  # read three times; digests only
    spellings_ = d.select("look", "spelling").distinct()
    pairs = spellings_.withColumnRenamed("spelling", "sa").join(spellings_.withColumnRenamed("spelling", "sb"), "look").filter("sa < sb").select("look", "sa", "sb")
    of = lambda s, j: d.select("look", F.col("spelling").alias(s), F.col("job_id").alias(j)).distinct()
    out = pairs.join(of("sa", "ja"), ["look", "sa"]).join(of("sb", "jb"), ["look", "sb"]).filter("ja <> jb")
    return out.select(F.least("ja", "jb").alias("job_id_a"), F.greatest("ja", "jb").alias("job_id_b")).distinct()
