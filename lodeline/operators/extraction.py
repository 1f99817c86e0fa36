"""Evidence extraction with an injected client, its validation, resumption, release gates and path rules."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.operators.graph import RELATION_TYPES
from lodeline.runtime import bounded

SKILL = "struct<canonical_name:string,surface:string,category:string,evidence_span:string>"
RELATION = "struct<source:string,type:string,target:string,evidence_span:string>"
EVIDENCE = f"record_id string, source_text string, skills array<{SKILL}>, relations array<{RELATION}>"


def pending(requests: DataFrame, done: DataFrame, key: str = "record_id") -> DataFrame:
    """Requests without a stored answer."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def retried(call: Callable, attempts: int = 3, transient: Sequence[str] = ("timeout", "throttl", "temporar"), wait: Callable[[float], None] = time.sleep) -> Callable:
    """Repeat a remote call on errors that name a transient cause, waiting twice as long each time."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                if n + 1 == attempts or not any(t in str(e).lower() for t in transient):
                    raise
                wait(2.0**n)

    return run


def extract(requests: DataFrame, client: Callable[[str], dict]) -> DataFrame:
    """Raw answers ``record_id, source_text, skills, relations`` of an injected client, one call for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "skills": pa.list_(pa.struct([(n, pa.string()) for n in ("canonical_name", "surface", "category", "evidence_span")])),
            "relations": pa.list_(pa.struct([(n, pa.string()) for n in ("source", "type", "target", "evidence_span")])),
        }
        for b in batches:
            got = [client(t or "") for t in b.column("source_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("source_text"), *[pa.array([g.get(k, []) for g in got], kind) for k, kind in kinds.items()]], names=["record_id", "source_text", *kinds])

    return requests.select("record_id", "source_text").mapInArrow(run, EVIDENCE)


def validated(evidence: DataFrame) -> DataFrame:
    """Keeps skills and relations that the text bears out and counts the others.

    A skill's span stands in the text and its surface in the span, each name once; a relation's ends are kept skills, its type is allowed, its span
    stands in the text, and it doesn't end where it starts.
    """
    text = F.col("source_text")
    borne = F.filter("skills", lambda s: (s["surface"] != "") & F.contains(text, s["evidence_span"]) & F.contains(s["evidence_span"], s["surface"]))
    e = evidence.withColumn("_s", borne).withColumn("_n", F.transform("_s", lambda s: s["canonical_name"]))
    e = e.withColumn("_s", F.filter("_s", lambda s, i: F.array_position(F.col("_n"), s["canonical_name"]) == i + 1)).withColumn("_n", F.transform("_s", lambda s: s["canonical_name"]))
    good = F.filter(
        "relations",
        lambda r: F.array_contains(F.col("_n"), r["source"]) & F.array_contains(F.col("_n"), r["target"]) & r["type"].isin(RELATION_TYPES) & (r["source"] != r["target"]) & F.contains(text, r["evidence_span"]),
    )
    e = e.withColumn("_r", good)
    return e.select(
        "record_id",
        "source_text",
        F.col("_s").alias("skills"),
        F.col("_r").alias("relations"),
        (F.size("skills") - F.size("_s")).alias("skill_rejection_count"),
        (F.size("relations") - F.size("_r")).alias("relation_rejection_count"),
    )


def approved(delta: float, least: float, significant: bool, official: bool) -> bool:
    """A challenger is promoted on a significant official gain of NDCG@10 of at least ``least``."""
    return official and significant and delta > 0 and delta >= least


def required_artifacts(objects: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Objects under the prefixes of enabled components (a small table)."""
    return objects.join(bounded(prefixes.select("prefix").distinct(), 10_000, "prefixes"), F.startswith(F.col("path"), F.col("prefix")), "left_semi")


def path_words(path: Column) -> Column:
    """Words of a path: all signs but letters and digits are separators."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "_"), lambda w: w != "")


def forbidden_paths(objects: DataFrame, words: Sequence[str]) -> DataFrame:
    """Objects whose path holds a forbidden word."""
    return objects.filter(F.arrays_overlap(path_words(F.col("path")), F.array(*[F.lit(w) for w in words])))
