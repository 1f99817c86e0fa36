"""Taxonomies: containment expansion, reversal and all-or-nothing resolution of codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paths(rows: DataFrame) -> DataFrame:
    """``code, own, path`` from ``codeno, codenamea, codenameb, codenamec``: own name first, distinct names up to the root."""
    names = F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("codenamea", "codenameb", "codenamec")])
    return rows.select(F.col("codeno").alias("code"), F.trim("codenamea").alias("own"), F.array_distinct(F.filter(names, lambda x: x != "")).alias("path"))


def expand(rows: DataFrame, passes: int = 1) -> DataFrame:
    """``code, term``: the names of every row whose path holds the code's whole path.

    Containment runs as an equi-join: each code's own set meets rows on its first name and is then compared, instead of a nested loop. Two passes
    repeat the expansion on the expanded sets.
    """
    sets = paths(rows).select("code", F.col("path").alias("terms"))
    for _ in range(passes):
        keyed = sets.select("code", "terms", F.element_at("terms", 1).alias("term"))
        members = sets.select(F.explode("terms").alias("term"), F.col("terms").alias("other"))
        held = keyed.join(members, "term").filter(F.size(F.array_except("terms", "other")) == 0)
        sets = held.groupBy("code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("other")))).alias("terms"))
    return sets.select("code", F.explode("terms").alias("term"))


def reverse(expanded: DataFrame) -> DataFrame:
    """``term, codes``: sorted codes of each term."""
    return expanded.groupBy("term").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def resolve(requests: DataFrame, expanded: DataFrame) -> DataFrame:
    """``qid, terms`` for ``qid, codes``: the union of the codes' terms; null if any code is unknown; empty for no codes."""
    wanted = requests.select("qid", F.explode(F.array_distinct("codes")).alias("code"))
    known = expanded.groupBy("code").agg(F.collect_set("term").alias("terms"))
    met = wanted.join(known, "code", "left")
    per = met.groupBy("qid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"), F.count_if(F.col("terms").isNull()).alias("unknown"))
    out = requests.select("qid", "codes").join(per, "qid", "left")
    return out.select("qid", F.when(F.size("codes") == 0, F.array().cast("array<string>")).when(F.col("unknown") == 0, F.col("terms")).alias("terms"))


def from_rows(rows: DataFrame, code: str, term: str) -> DataFrame:
    """``code, term`` as the rows themselves state it, where no taxonomy is given."""
    return rows.select(F.col(code).alias("code"), F.col(term).alias("term")).filter((F.col("code") != "") & (F.col("term") != "")).distinct()


def children(rows: DataFrame, of: list[str]) -> DataFrame:
    """``path, code, has_children``: the nodes one level below a path (names from the top), with the codes of those that are options themselves (null for
    others) and whether anything lies below them."""
    down = F.reverse("path")
    depth = len(of)
    below = paths(rows).select("code", down.alias("path")).filter((F.size("path") > depth) & (F.slice("path", 1, depth) == F.array(*[F.lit(x) for x in of]).cast("array<string>")))
    nodes = below.select(F.slice("path", 1, depth + 1).alias("node"), F.when(F.size("path") == depth + 1, F.col("code")).alias("code"))
    held = nodes.groupBy("node").agg(F.collect_set("code").alias("codes"), F.max(F.col("code").isNull()).alias("has_children"))
    return held.select(F.array_join("node", "/").alias("path"), F.explode_outer("codes").alias("code"), "has_children")
